import random

import brute
from pyspark.sql import functions as F

from foliant.llm import jaccard
from foliant.llm.components import components


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, 3), (3, 7), (5, 5)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def varied(rng, words, word, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.choice([0, 1, 2])] = [rng.choice(word)] if rng.random() < 0.8 else []
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    word = [f"w{k}" for k in range(500)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one two three four five"), (6, "x " * 9000), (7, "X " * 50), (None, "one two")]
    at = 10
    passage = [rng.choice(word) for _ in range(60)]
    for g in range(25):
        base = [rng.choice(word) for _ in range(rng.choice([6, 20, 60, 150, 400]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(rng.choice([1, 2, 5, 12])):
            docs.append((at, " ".join(varied(rng, base, word, rng.randrange(1 + len(base) // 12)))))
            at += rng.choice([1, 3, 1000])
            if rng.random() < 0.3:
                base = varied(rng, base, word, 1 + len(base) // 30)  # chains
            if rng.random() < 0.2:
                docs.append((at, docs[-1][1].upper()))
                at += 1
    rng.shuffle(docs)
    docs.append(docs[12])
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, token string").repartition(5)
    got = jaccard.link(frame).collect()
    assert len(got) == len(docs)
    want = brute.near_components([d for d in docs if d[0] is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    assert jaccard.link(frame.limit(0)).count() == 0


def test_frequent_shingles_are_salted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    test_equals_brute_force(spark)


def test_least_shared_bounds_every_linked_pair(spark):
    # sets of m and n with overlap o that link: their regions share as many as the bound says
    worst = []
    for n in (*range(1, 60), 100, 333, 1000):
        for m in range(-(-75 * n // 100), n * 100 // 75 + 1):
            for o in range(min(m, n), 0, -1):
                if 100 * o < 75 * (m + n - o):
                    break
                region = [k * 30 // 100 + 1 for k in (n, m)]
                worst.append((n, min(region[0] - (n - o), region[1] - (m - o))))
    frame = spark.createDataFrame(worst, "n long, shared long").groupBy("n").agg(F.min("shared").alias("shared"))
    assert frame.where(jaccard.least_shared(F.col("n"), 75, 30) > F.col("shared")).count() == 0


def test_many_similar_sets_that_do_not_link(spark):
    rng = random.Random(4)
    common = [f"c{k}" for k in range(70)]
    docs = [(d, " ".join([*common, *(f"x{rng.randrange(300)}" for _ in range(30))])) for d in range(1200)]
    docs += [(5000, docs[7][1]), (5001, docs[9][1] + " more"), (5002, docs[9][1].upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.near_components(docs)


def test_long_texts_are_in_groups_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 1 << 12)
    monkeypatch.setattr(jaccard, "VISITOR_TOKENS", 1 << 12)
    rng = random.Random(6)
    base = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    docs = [(k, " ".join(varied(rng, base[: rng.choice([3_000, 20_000, 120_000])], base, 200))) for k in range(9)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_components(docs)


def test_an_id_with_two_texts_has_the_links_of_both(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, "short"), (8, "short")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 36, 1), (5, 36, 1), (5, 36, 1), (7, 36, 1), (8, 1, 8), (9, 1, 8), (9, 36, 8)]
