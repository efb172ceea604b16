import random

import brute

from foliant.llm import substring as S


def test_equals_brute_force(spark):
    rng = random.Random(1)
    word = [f"w{k}" for k in range(40)]
    long = [rng.choice(word) for _ in range(3000)]
    docs = [(0, None), (1, ""), (2, " ".join(long)), (3, " ".join(long)), (3, " ".join(long)), (4, "a " * 80), (5, "a " * 49), (6, "a\n" * 50), (7, "a\t" * 300 + "b")]
    for k in range(8, 60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(2900)
            parts += long[a : a + rng.choice([30, 49, 50, 51, 70])] if rng.random() < 0.7 else [rng.choice(word) for _ in range(rng.randrange(80))]
        docs.append((1000 - k * 7, " ".join(parts)))
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, seeds string, h int").repartition(5)
    got = S.deduplicate(frame).collect()
    want = brute.deduplicated(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        w = brute.SPACE.findall(dict(docs)[r.doc_id] or "")
        for f in r.factors:  # each is found word by word in its source
            assert f.length >= 50 and f.source < r.doc_id
            assert w[f.start : f.start + f.length] == brute.SPACE.findall(dict(docs)[f.source])[f.position : f.position + f.length]
    assert S.deduplicate(frame.limit(0)).count() == 0


def test_rows_without_id_stay(spark):
    frame = spark.createDataFrame([(None, "a b " * 60), (1, "a b " * 60)], "doc_id long, text string")
    assert sorted(r.n_removed for r in S.deduplicate(frame).collect()) == [0, 0]


def test_texts_that_share_an_id_keep_their_own_words(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(70)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, f"x {b} y")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 70, 0), (2, 70, 0), (2, 70, 70), (3, 72, 70)]
