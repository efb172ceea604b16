"""Operators that learn: language model, quality rules, neighbours and toxicity."""

import math
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import _packets, neighbours, pitman_yor, rules, toxicity

DATA = "/root/testdata/sf0.01"
EDGES = [(900001, None), (900002, ""), (900003, " \n\t "), (900004, "word " * 30000), (900005, "tie tie"), (900005, "tie tie"), (None, "no id")]


def made(n=400, seed=3):
    rng = random.Random(seed)
    word = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(800)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(word) if rng.random() < 0.6 else "the" for _ in range(rng.randrange(30, 80))) + "\n"
        toxic, bad = k % 9 == 0, k % 7 == 0
        if toxic:
            w = text.split(" ")
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Moron,", "scummy", "scumbag"])
            text = " ".join(w)
        if bad:
            text = text.replace(" ", "### ") if k % 2 else text.upper().replace(" ", "!! ")
        rows.append((k, text, int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = made()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t, *_ in rows] + [(d, t, "x", 1) for d, t in EDGES], "doc_id long, text string, score string, n_words int").repartition(3)
    labels = spark.createDataFrame([(d, q, t) for d, _, q, t in rows] + [(None, 1, 1), (5_000_000, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_stirling_and_seating():
    d = 0.4
    table = pitman_yor.stirling(d)
    # of three customers: one table (1-d)(2-d) ways, two tables 3(1-d) ways, three tables one way
    assert np.allclose(np.exp(table[3, 1:4]), [(1 - d) * (2 - d), 3 * (1 - d), 1])
    u = (np.arange(20000) + 0.5) / 20000
    t = pitman_yor.seat(np.full(20000, 3), np.full(20000, 2.0), d, u, table)
    p = np.array([(1 - d) * (2 - d) * 2, 3 * (1 - d) * 4, 8])
    assert np.allclose(np.bincount(t, minlength=4)[1:] / 20000, p / p.sum(), atol=0.01)
    large = pitman_yor.seat(np.full(2000, 100_000), np.full(2000, 1.5), d, u[::10], table)
    assert large.min() >= 1 and large.max() <= 100_000


def test_letters_are_a_distribution():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 257**3, 300))
    letters = pitman_yor.fit_letters(key, rng.integers(1, 200, len(key)), None, 1)
    for pair in (int(key[0] // 257), 256 * 257 + 256, 65 * 257 + 66):
        a, b = divmod(pair, 257)
        p = letters.back[pair] * letters.one[b * 257 : b * 257 + 257]
        seen = key // 257 == pair
        p[key[seen] % 257] = letters.p[seen]
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_language_model(spark, frames):
    docs, _ = frames
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model, vocabulary = pitman_yor.fit(docs.where(~held))
    got = pitman_yor.score(docs, model, vocabulary).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(rows)
    # the repeated row counts twice in training, the row without id once
    keyed = [(k, t) for k, (_, t) in enumerate(rows)]
    want = brute.base_scores(keyed, lambda k: rows[k][0] is not None and zlib.crc32(str(rows[k][0]).encode()) % 7 == 2)
    by = {rows[k][0]: v for k, v in want.items()}
    for r in got:
        n, known, tokens, base = by[r.doc_id]
        assert (r.n_tokens, r.n_known, model.tokens) == (n, known, tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
    assert all(r.perplexity > 0 for r in pitman_yor.perplexity(pitman_yor.score(docs, model, vocabulary)).collect())
    # known words and the unknown one share a mass of 1
    p = 0.0
    for h, w, c in vocabulary.select("h", "word", "c").collect():
        s, at = pitman_yor.spelled(np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(w.encode())]))
        p += model.probability(np.array([h]), np.array([c]), s, at, pitman_yor.stirling(model.discount))[0]
    assert p < 1


def test_language_model_is_better_than_add_one_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model, vocabulary = pitman_yor.fit(docs.where(~held))
    got = pitman_yor.score(docs.where(held), model, vocabulary).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.2


def test_language_model_knows_the_order_of_words(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "FREQUENT", 3)  # some words and pairs are joined, some sent along
    monkeypatch.setattr(pitman_yor, "FREQUENT_PAIRS", 3)
    lines = ["the cat sat on the mat", "a dog ran in the park", "the cat ran on a mat", "the cat sat in the park"]
    model, vocabulary = pitman_yor.fit(spark.createDataFrame([(k, lines[k % 4]) for k in range(40)], "doc_id long, text string"))
    texts = ["the cat sat on the mat", "mat the on sat cat the", "the zebra sat", "", "a a a park"]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, vocabulary).collect()}
    assert got[0] > got[1] + 2
    # the same from the seating, pair by pair
    words, alone, table = {"": (0, model.ends, model.end_room)}, {}, pitman_yor.stirling(model.discount)
    words |= {r.word: (r.h, r.n, r.room) for r in vocabulary.collect()}
    customers = {r.word: r.c for r in vocabulary.collect()} | {"": model.end_customers}
    known = 0.0
    for w, (h, _, _) in words.items():
        s, at = pitman_yor.spelled(np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(w.encode())]))
        alone[w] = model.probability(np.array([h]), np.array([customers[w]]), s, at, table)[0]
        known += model.base(s, at)[0]
    unknown = model.unknown(known)
    assert math.isclose(sum(alone.values()) + unknown, 1, rel_tol=1e-9)
    pairs = {(r.a, r.b): (r.c, r.t) for r in model.pairs.collect()}

    def p(a, b):
        h, n, room = words.get(a, (None, 0, 1))
        c, t = pairs.get((h, words[b][0]), (0, 0)) if b in words else (0, 0)
        return (c - model.pair_discount * t + room * alone.get(b, unknown)) / (1 + n)

    for a in words:
        assert math.isclose(sum(p(a, b) for b in words) + p(a, "zebra"), 1, rel_tol=1e-9)
    for k, text in enumerate(texts):
        w = ["", *text.split(), ""]
        assert math.isclose(got[k], sum(math.log10(p(a, b)) for a, b in zip(w, w[1:], strict=False)), rel_tol=1e-9)


@pytest.mark.parametrize("full", [False, True])
def test_language_model_has_every_pair(spark, monkeypatch, full):
    monkeypatch.setattr(pitman_yor, "FREQUENT", 9)
    monkeypatch.setattr(pitman_yor, "FREQUENT_PAIRS", 3)
    if full:  # no pair is surely left out of those listed, as with more pairs than the sieve has bits

        def filled(*args, sieve=pitman_yor.Sieve):
            made = sieve(*args)
            made.map = spark.sparkContext.broadcast(np.full_like(made.map.value, 255))
            return made

        monkeypatch.setattr(pitman_yor, "Sieve", filled)
    rows = [(k, t.lower()) for k, t, *_ in made(40, 5)] + [(40, "only here twice only here"), (41, None), (42, "the zebra the"), (43, "rare1 rare2 the rare1 rare2 rare3"), (43, "rare4 the rare5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    held = F.col("doc_id") % 4 == 2
    train, others = docs.where(~held), docs.where(held)
    model, vocabulary = pitman_yor.fit(train)
    texts = [(t or "").split() for k, t in rows if k % 4 != 2]
    counts = {}
    for w in texts:
        for pair in zip(["", *w], [*w, ""], strict=True):
            counts[pair] = counts.get(pair, 0) + 1
    word = {r.h: r for r in vocabulary.collect()}
    name = {0: ""} | {h: r.word for h, r in word.items()}
    seated = {(name[r.a], name[r.b]): (r.c, r.t) for r in model.pairs.collect()}
    assert {k: c for k, (c, _) in seated.items()} == counts and sum(c == 1 for c in counts.values()) > 500
    # the probability of each text, pair by pair
    n, room, customers = ({"": x} | {r.word: r[y] for r in word.values()} for x, y in ((model.ends, "n"), (model.end_room, "room"), (model.end_customers, "c")))
    alone, known = {}, 0.0
    for w, h in {v: k for k, v in name.items()}.items():
        s, at = pitman_yor.spelled(np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(w.encode())]))
        alone[w] = model.probability(np.array([h]), np.array([customers[w]]), s, at, pitman_yor.stirling(model.discount))[0]
        known += model.base(s, at)[0]
    unknown = model.unknown(known)

    def p(a, b):
        c, t = seated.get((a, b), (0, 0))
        return (c - model.pair_discount * t + room.get(a, 1) * alone.get(b, unknown)) / (1 + n.get(a, 0))

    for a in ("", "the", "rare1"):
        assert math.isclose(sum(p(a, b) for b in n) + p(a, "zebra"), 1, rel_tol=1e-9)
    want = sorted((k, sum(math.log10(p(a, b)) for a, b in zip(["", *(t or "").split()], [*(t or "").split(), ""], strict=True))) for k, t in rows)
    few, words = pitman_yor.fit(train, others=others)
    asked = {pair for k, t in rows if k % 4 == 2 for pair in zip(["", *t.split()], [*t.split(), ""], strict=True)}
    assert few.pairs.count() == sum(c > 1 or k in asked for k, c in counts.items()) < len(counts)
    for scored in (pitman_yor.score(docs, model, vocabulary), pitman_yor.score(docs, model, vocabulary, trained=~held), pitman_yor.score(docs, few, words, trained=~held)):
        got = sorted((r.doc_id, r.score) for r in scored.collect())
        assert all(k == i and math.isclose(x, y, rel_tol=1e-9) for (k, x), (i, y) in zip(got, want, strict=True))


def test_language_model_has_the_first_pairs_of_a_slice(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "FREQUENT", 3)
    lines = ["rare1 rare2 rare3 the cat", *["the cat sat on the mat", "a dog sat on a cat"] * 10]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1)
    model, vocabulary = pitman_yor.fit(docs)
    want = {r.doc_id: r.score for r in pitman_yor.score(docs, model, vocabulary).collect()}
    few, words = pitman_yor.fit(docs, others=docs.limit(0))
    got = {r.doc_id: r.score for r in pitman_yor.score(docs, few, words, trained=F.lit(True)).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_language_model_of_nothing(spark, frames):
    docs, _ = frames
    model, vocabulary = pitman_yor.fit(docs.limit(0))
    got = pitman_yor.score(docs, model, vocabulary).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and abs(r.score) < 1e-9 for r in got)  # the unknown word is all there is
    assert pitman_yor.score(docs.limit(0), model, vocabulary).count() == 0


def test_pairs_go_through_shuffles_in_packets(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "FREQUENT_PAIRS", 3)
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 400, 100))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    held = F.col("doc_id") % 7 == 2
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        """Rows that each stage so far has sent."""
        none = spark._jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = set(shuffled())
    model, vocabulary = pitman_yor.fit(docs.where(~held), others=docs.where(held))
    assert len(pitman_yor.score(docs, model, vocabulary, trained=~held).collect()) == 1500
    # over 90,000 pairs are counted, and most of 150,000 are looked up
    assert max(n for k, n in shuffled().items() if k not in before) < 20_000


def test_packets_are_what_was_packed(monkeypatch):
    rng = np.random.default_rng(0)
    key, n, x = rng.integers(-(2**63), 2**63, 5000), rng.integers(0, 9, 5000), rng.normal(size=5000)
    x[::7] = np.nan
    bucket = _packets.place(key, 64)
    batches = [*_packets.packed(3, bucket, key, n, x), *_packets.packed(3, bucket, key, 0 * n, x), *_packets.packed(2, bucket, 0 * n)]
    assert list(_packets.packed(1, bucket[:0], key[:0])) == []
    dealt = pa.Table.from_batches(batches).sort_by([("bucket", "ascending"), ("kind", "ascending")]).combine_chunks().to_batches()
    monkeypatch.setattr(_packets, "LIMIT", 1 << 12)
    parts = list(_packets.whole(iter(dealt)))
    got = [_packets.unpacked(part, 3, "qqd") for part in parts]
    assert len(got) > 3 and sum(len(set(g[0])) for g in got) == 64  # no bucket is cut
    of, k, m, y = (np.concatenate(c) for c in zip(*got, strict=True))
    assert np.array_equal(of, _packets.place(k, 64))
    at, want = np.lexsort((m, k)), np.lexsort((np.append(n, 0 * n), np.append(key, key)))
    for c, w in ((k, np.append(key, key)), (m, np.append(n, 0 * n)), (y, np.append(x, x))):
        assert np.array_equal(c[at], w[want], equal_nan=c.dtype == float)
    assert sum(len(_packets.unpacked(part, 2, "q")[1]) for part in parts) == 5000


def test_statistics_equal_brute_force(spark, frames):
    docs, _ = frames
    texts = ["a\na\n b\na ", "x y z " * 9, "\n\n", "é€ é€", "one two three four five six seven eight one two three four five six seven eight", None]
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    want = {r.doc_id: brute.statistics(r.text) for r in every.collect()}
    for r in rules.statistics(every).collect():
        assert tuple(r)[1:6] == want[r.doc_id], r.doc_id


def test_rules(spark, frames):
    docs, labels = frames
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    assert not got[900001].kept and got[900001].base_failed and got[900004].base_failed
    quality = {d: q for d, _, q, _ in made()}
    assert sum(got[d].kept == bool(q) for d, q in quality.items()) > 0.97 * len(quality)
    found = rules.fit(rules.statistics(docs), labels)
    assert found and all(str(c) for r in found for c in r)
    assert rules.fit(rules.statistics(docs), labels.limit(0)) == []
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_neighbours(spark, frames):
    docs, labels = frames
    train = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    space = neighbours.fit(docs, train)
    got = neighbours.score(docs, space).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [(d, q) for d, _, q, _ in made() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((by[d] >= 0.3) == bool(q) for d, q in held) > 0.95 * len(held)
    assert by[900001] == by[900002]
    # exact: the same votes as from all cosines sorted
    x = np.random.default_rng(1).random((7, neighbours.TERMS), dtype=np.float32)
    cosine = space.project(x) @ space.vectors.T
    for k, v in enumerate(space.vote(x)):
        near = np.argsort(-cosine[k])[: neighbours.NEIGHBOURS]
        w = np.maximum(cosine[k][near], 1e-6).astype(float) ** neighbours.SHARPNESS
        assert math.isclose(v, (w * space.label[near]).sum() / w.sum(), rel_tol=1e-4)
    kept = neighbours.score(docs, space, keep=docs.columns, least=0.3)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in got)
    none = neighbours.fit(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in neighbours.score(docs, none).collect())
    assert neighbours.score(docs.limit(0), space).count() == 0


def test_messages_equal_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        logit, a, start = rng.normal(size=n), np.exp(rng.normal(size=(2, 2))), 0.7
        total = np.zeros(n)
        z = 0.0
        for y in np.ndindex(*(2,) * n):
            w = math.exp(sum(logit[k] for k in range(n) if y[k])) * (start if y[0] else 1) * math.prod(a[y[k], y[k + 1]] for k in range(n - 1))
            z += w
            total += w * np.array(y)
        assert np.allclose(toxicity.marginals(logit, np.array([0]), a, start)[0], total / z)
    # over blocks and documents
    logit = rng.normal(size=2000)
    begin = np.array([0, 300, 301, 1500])
    whole = toxicity.marginals(logit, begin, a, start)[0]
    parts = [toxicity.marginals(logit[s:e], np.array([0]), a, start)[0] for s, e in zip(begin, [*begin[1:], 2000], strict=True)]
    assert np.allclose(whole, np.concatenate(parts))


def test_toxicity(spark, frames):
    docs, labels = frames
    train = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chain = toxicity.fit(docs, train)
    got = toxicity.score(docs, chain).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by, text = {r.doc_id: r for r in got}, {d: t for d, t, *_ in made()}
    held = [(d, t) for d, _, _, t in made() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((by[d].score >= 0.5) == bool(t) for d, t in held) > 0.95 * len(held)
    found = {text[d][s.start : s.end].lower() for d, t in held if t for s in by[d].spans}
    assert any("moron" in f or "scum" in f for f in found)
    assert by[900001].score == by[900002].score < 0.5
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(1)
    plain = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "words", "more"]) for _ in range(n))
    rows = [(k, plain(7000) + (" scumbag moron " + plain(7000) if k % 4 == 0 else plain(7000)), int(k % 4 == 0)) for k in range(16)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    assert min(len(r[1]) for r in rows) > 1 << 16
    assert len(toxicity.fit(docs, labels).key) > 0
    assert len(toxicity.fit(docs, labels, toxic_sample=0).key) == 0


def test_neighbours_know_words(spark):
    """Texts whose characters are of the same kinds, told apart by their words only."""
    rng = random.Random(9)
    good, bad = ["table", "river", "maple", "solar", "pilot"], ["label", "liver", "cable", "polar", "rival"]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(40)), k % 2) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 80], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in neighbours.score(docs, neighbours.fit(docs, labels)).collect()}
    assert all((got[k] >= 0.5) == bool(y) for k, _, y in rows[80:])


def test_neighbours_bound_what_they_learn(spark):
    docs = spark.createDataFrame([(k % 7, f"text {k % 11} of many") for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 7, k % 2) for k in range(70)], "doc_id long, quality int")
    spaces = [neighbours.fit(docs.repartition(n), labels, sample=20) for n in (1, 5)]
    assert len(spaces[0].label) == 20 and (spaces[0].label == spaces[1].label).all()
    assert np.allclose(np.abs(spaces[0].vectors @ spaces[0].vectors.T), np.abs(spaces[1].vectors @ spaces[1].vectors.T), atol=1e-3)


def test_rules_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"words {k % 3} " * 30) for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, k % 2) for k in range(50)], "doc_id long, quality int")
    assert isinstance(rules.fit(rules.statistics(docs), labels, sample=5), list)
    assert rules.judge(docs, labels).count() == 500
