import random

import brute

from foliant.llm import decontam as D

DOCS = [
    (1, "x y " + " ".join(f"w{k}" for k in range(30)) + " z"), (2, None), (3, ""), (4, "SHORT item here"), (5, "short ITEM, here!"),
    (6, " ".join(f"w{k}" for k in range(5, 15))), (7, " ".join(f"w{k}" for k in range(5, 14))), (8, "nothing " * 5000), (8, "nothing " * 5000),
    (9, "short item"), (10, "é1 é2 " * 3), (11, "one one one one"),
]
ITEMS = [(10, " ".join(f"W{k}" for k in range(30))), (2, "Short item here"), (3, None), (4, ""), (5, "é1 é2"), (6, "one"), (7, "Short item here")]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "t") for r in DOCS], "doc_id long, text string, n_words string").repartition(3)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, doc_id int")
    want = brute.decontaminated(DOCS, ITEMS)
    for size in (D.BLOCK_BYTES, 40):  # in one block and in several
        got = D.report(docs, items, block_bytes=size).collect()
        assert len(got) == len(DOCS)
        assert {r[0]: tuple(r)[1:] for r in got} == want
    clean = D.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in DOCS if not want[d][-1])


def test_longest_match_and_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r.doc_id: r.matches for r in D.locate(docs, items).collect()}
    assert [tuple(m) for m in found[1]] == [("10", 2, 0, 30)]
    assert D.report(docs.limit(0), items).count() == 0
    assert D.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_a_benchmark_of_many_blocks(spark, monkeypatch):
    rng = random.Random(8)
    word = [f"w{k}" for k in range(300)]
    items = [(k % 150, " ".join(rng.choice(word) for _ in range(rng.choice([1, 5, 12, 30])))) for k in range(200)] + [(900, "w1 w2 w3")] * 50
    items += [(1000 + k, "w7 w8 w9 w7 w8") for k in range(40)]
    docs = [(d, " ".join(w for _ in range(4) for w in ([rng.choice(word) for _ in range(20)] + rng.choice(items)[1].split()))) for d in range(60)]
    want = brute.decontaminated(docs, items)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size, most, index = sum(len(t) for _, t in set(items)), [], D.index
    monkeypatch.setattr(D, "index", lambda part, window: most.append(sum(len(t) for _, t in part)) or index(part, window))
    got = {r[0]: tuple(r)[1:] for r in D.report(frame, bench, block_bytes=-(-size // 20)).collect()}
    assert got == want and len(most) == 20 and max(most) < size / 5  # what the driver holds at once
    assert sorted(r.doc_id for r in D.decontaminate(frame, bench, block_bytes=-(-size // 20)).collect()) == sorted(d for d, w in want.items() if not w[-1])
    one, many = ({r.doc_id: sorted(map(tuple, r.matches)) for r in D.locate(frame, bench, block_bytes=b).collect()} for b in (1 << 20, -(-size // 20)))
    assert one == many
