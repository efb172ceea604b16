import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import packing as P

PLAIN = Tokenizer.from_file(P.default_tokenizer())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_those_of_tokenizers(text):
    plain = PLAIN
    assert P.encoder(P.default_tokenizer())(text) == plain.encode(text, add_special_tokens=False).ids


def test_added_token_in_a_text():
    plain = Tokenizer.from_file(P.default_tokenizer())
    text = "a <|endoftext|> b" + "x" * 3000
    assert P.encoder(P.default_tokenizer())(text) == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_fills_sequences_without_gaps(counts):
    fill = {}
    slots = []
    for length, a, b, seq, each, at in P.plan(counts, 64):
        for k in range(b - a):
            slots.append((seq + k // each, at + k % each * length, length))
    for seq, at, length in sorted(slots):
        assert fill.get(seq, 0) == at
        fill[seq] = at + length
    assert all(v <= 64 for v in fill.values())
    assert sum(counts.values()) == len(slots)
    # as many sequences as placing item by item takes
    rooms = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - length)
    assert len(fill) == len(rooms)


def test_plan_is_bounded():
    rng = np.random.default_rng(0)
    small = P.plan({k: int(v) for k, v in enumerate(rng.integers(1, 1000, 1024), 1)}, 1024)
    large = P.plan({k: int(v) for k, v in enumerate(rng.integers(1, 10**12, 1024), 1)}, 1024)
    assert len(small) < 20_000 and len(large) < 20_000


def test_pack_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 3000, "x"), (4, "tie", "x"), (4, "tie", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(2)
    got = sorted((tuple(r) for r in P.pack(docs).collect()), key=lambda r: (r[0] or 0, r[1]))
    by_doc = {}
    for r in got:
        by_doc.setdefault(r[0], []).append(r)
    assert [(r[3], r[4]) for r in by_doc[1] + by_doc[2]] == [(1, zlib.crc32(np.array([2], "<u4").tobytes()))] * 2
    ids = P.encoder(P.default_tokenizer())("word " * 3000) + [2]
    assert sum(r[3] for r in by_doc[3]) == len(ids)
    assert [r[3] for r in by_doc[3]][1:] == [1024] * (len(by_doc[3]) - 1)
    assert len(by_doc[4]) == 2 and len(by_doc[None]) == 1
    assert len({(r[5], r[6]) for r in got}) == len(got)
    fill = {}
    for r in sorted(got, key=lambda r: (r[5], r[6])):
        assert fill.get(r[5], 0) == r[6]
        fill[r[5]] = r[6] + r[3]
    assert P.pack(docs.limit(0)).count() == 0


def test_other_files_go_through_tokenizers(tmp_path):
    import json

    spec = json.load(open(P.default_tokenizer(), encoding="utf-8"))
    assert P.encoder(P.default_tokenizer())("a b") == [64, 275]
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(str(path))
    for text in ("the other way round", "merging in reverse"):
        assert P.encoder(str(path))(text) == want.encode(text, add_special_tokens=False).ids
