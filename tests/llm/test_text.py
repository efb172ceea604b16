import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import _text as T
from foliant.llm._shared import Sieve, clean, dropped, written
from foliant.llm.substring import smallest

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab Z9\n\t\x0b\x1c\x85é€😀-_.")), max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans(), st.integers(1, 40))
def test_words_equal_the_patterns(texts, fold, limit):
    data, off = T.view(pa.array(texts, pa.string()))
    got, known = [], {}
    for i, j in T.slices(off, limit):
        for kind, pattern in ((T.SPACE, brute.SPACE), (T.ALNUM, brute.ALNUM)):
            w = T.Words(data, off[i : j + 1], kind, fold or kind is T.ALNUM)
            for d in range(j - i):
                text = texts[i + d] or ""
                text = text.translate(brute.FOLD) if fold or kind is T.ALNUM else text
                assert [w.text(k) for k in range(w.first[d], w.first[d + 1])] == pattern.findall(text)
            for k, h in enumerate(w.hashes().tolist()):
                assert known.setdefault(w.text(k), h) == h
        got += range(i, j)
    assert got == [*range(len(texts))] and len(set(known.values())) == len(known)


def test_grams_and_minima():
    h = np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)
    h[200:260] = h[20:80]
    for n in (1, 2, 5, 8, 16, 50):
        g = T.grams(h, n)
        assert len(g) == 301 - n and (g[200 : 261 - n] == g[20 : 81 - n]).all() and len(set(g.tolist())) == 240
        assert (smallest(h, n) == np.lib.stride_tricks.sliding_window_view(h, n).min(1)).all()
    assert len(T.grams(h, 301)) == 0
    s, e = T.runs(np.array([1, 1, 0, 1], bool))
    assert s.tolist() == [0, 3] and e.tolist() == [2, 4]


def test_long_words():
    long = "x" * (3 << 20)
    data, off = T.view(pa.array([long + " a", "b " + long]))
    w = T.Words(data, off)
    h = w.hashes()
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_sieve_never_loses_a_member(spark):
    ids = [0, 1, 5, -3, 2**40, 2**62 + 7, 65536, 131072 + 9]
    frame = spark.createDataFrame([(i, "t") for i in range(200)] + [(i, "t") for i in ids] + [(None, "t")], "doc_id long, text string")
    sieve = Sieve(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    yes, no = (sieve.split(frame, "doc_id", m) for m in (True, False))
    found = {r.doc_id for r in yes.collect()}
    assert set(ids) | {None} <= found and len(found) < 30
    assert yes.count() + no.count() == frame.count()


def test_written_tables_go_when_told(spark):
    a, b = (written(spark.range(5), "probe") for _ in range(2))
    paths = [f.rsplit("/", 1)[0].removeprefix("file://") for x in (a, b) for f in x.inputFiles()[:1]]
    import os

    assert all(map(os.path.isdir, paths))
    dropped(a)
    assert not os.path.isdir(paths[0]) and os.path.isdir(paths[1])
    clean(spark)
    assert not os.path.isdir(paths[1])
