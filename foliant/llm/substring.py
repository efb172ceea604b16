"""Exact substring deduplication by relative Lempel-Ziv parsing.

The reference is the documents themselves, indexed in blocks: a block holds, for the fingerprints
of its range, the first document with that window of `window` words and the window's place there.
Every document is parsed greedily against all blocks: at a word whose window is indexed with a
smaller document a factor (start, length, source, position) begins, and it goes on word by word
while the source goes on too.  Where a factor ends, the windows over its boundary are looked up
like all others, so the next factor may begin inside it and nothing is lost between two.  Factors
are `window` words long at least; together they are the duplicate spans.

Indexing every window would shuffle a row per word.  Instead the windows are reached through
seeds: the smallest hash among the `seed`-word grams of a window, which is the same for equal
windows wherever they stand, and common to some twenty neighbouring ones.  Only windows whose
seed occurs in two documents are indexed; all others cannot repeat.  A document that copies a
smaller one as a whole is one factor, settled before.  Windows are compared by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import Sieve, dropped, tidied, written
from foliant.llm._text import SPACE, Words, grams, mix, slices, view

WINDOW, SEED = 50, 16


def smallest(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours."""
    m, size = x, 1
    while size * 2 <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - size : n - size + len(x) - n + 1])


def _windows(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and seed of each window that lies in one document."""
    h = words.hashes()
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.flatnonzero(words.left()[: len(h) - window + 1] >= window)
    return place, smallest(grams(h, seed), window - seed + 1)[place]


def prints(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of word hashes."""
    return grams(h, window), grams(mix(h ^ np.uint64(0x5DEECE66D)), window)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def _unique(doc: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct values of each of n documents occur first, and where documents begin among them."""
    order = np.lexsort((x, doc))  # stable: places ascend
    new = np.ones(len(x), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (x[order][1:] != x[order][:-1])
    return order[new], np.searchsorted(doc[order][new], np.arange(n + 1))


def _profile(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = view(batch.column(2))
            for i, j in slices(off):
                words = Words(data, off[i : j + 1], SPACE)
                doc = words.doc()
                place, least = _windows(words, window, seed)
                h = words.hashes()
                nth = (np.arange(len(h)) - words.first[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                whole = [np.add.reduceat(np.append(mix(x), np.uint64(0)), words.first[:-1]) for x in (h ^ nth, h * np.uint64(0xD6E8FEB86659FD93) + nth)]
                sums = [pa.array(np.where(words.n > 0, s, 0).astype(np.uint64).view(np.int64)) for s in whole]
                which, first = _unique(doc[place], least, j - i)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:2]), pa.array(words.n.astype(np.int64)), *sums, _lists(least[which], first)], names=["doc_id", "text_key", "n_words", "s1", "s2", "seeds"])

    return run


def _indexed(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = view(batch.column(2))
            shared = batch.column(3)
            for i, j in slices(off):
                words = Words(data, off[i : j + 1], SPACE)
                place, least = _windows(words, window, seed)
                part = shared.slice(i, j - i)
                known = np.unique(part.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                place = place[np.isin(least, known, kind="sort")]
                doc = words.doc()[place]
                h, g = (x[place] for x in prints(words.hashes(), window)) if len(place) else (np.zeros(0, np.uint64),) * 2
                which, first = _unique(doc, h, j - i)
                at = (place - words.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:2]), *(_lists(x[which], first) for x in (h, g, at))], names=["doc_id", "text_key", "h", "g", "at"])

    return run


FACTOR = "struct<start:int,length:int,source:bigint,position:int>"


def factors(h: np.ndarray, g: np.ndarray, known: dict[str, np.ndarray], window: int) -> list[np.ndarray]:
    """Start, length, source and position of each factor of a document with these window hashes.

    known: the indexed windows (h ascending, g) with a smaller source, and the window's place there (at)."""
    near = np.minimum(np.searchsorted(known["h"], h), len(known["h"]) - 1)
    hit = np.flatnonzero((known["h"][near] == h) & (known["g"][near] == g))
    source, at = known["source"][near[hit]], known["at"][near[hit]]
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (source[1:] != source[:-1]) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(hit))) + window - 1
    return [hit[begin], size, source[begin], at[begin]]


def spans(start: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """The runs of words that factors, in order of their starts, cover."""
    out: list[tuple[int, int]] = []
    for s, e in zip(start.tolist(), (start + length).tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _known(found: pa.Scalar) -> dict[str, np.ndarray]:
    """The indexed windows of a document, in order of h."""
    values = found.values
    h = values.field("h").to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    return {"h": h[order], "g": values.field("g").to_numpy().view(np.uint64)[order], "source": values.field("source").to_numpy()[order], "at": values.field("at").to_numpy()[order]}


def _parsed(window: int, texts: bool):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("position", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
    names = ["n_words", "n_removed", "kept_sha256", "factors", "spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = view(batch.column(1))
            copied, found = batch.column(2), batch.column(3)
            out: list[tuple] = []
            for i, j in slices(off):
                words = Words(data, off[i : j + 1], SPACE)
                hashes = prints(words.hashes(), window) if any(found[d].is_valid for d in range(i, j)) else None
                for d in range(i, j):
                    a, n = int(words.first[d - i]), int(words.n[d - i])
                    parse = [np.zeros(0, np.int64)] * 4
                    if copied[d].is_valid and n >= window:
                        parse = [np.array([x]) for x in (0, n, copied[d].as_py(), 0)]
                    elif found[d].is_valid and n >= window:
                        parse = factors(*(x[a : a + n - window + 1] for x in hashes), _known(found[d]), window)
                    covered = spans(*parse[:2])
                    held = data[off[d] : off[d + 1]].tobytes().split()
                    kept, at = [], 0
                    for s, e in covered:
                        kept += held[at:s]
                        at = e
                    kept = b" ".join(kept + held[at:] if covered else held)
                    row = (n, sum(e - s for s, e in covered), hashlib.sha256(kept).hexdigest())
                    if texts:
                        row += ([dict(zip(("start", "length", "source", "position"), f, strict=True)) for f in zip(*(x.tolist() for x in parse), strict=True)], [{"start": s, "end": e} for s, e in covered], kept.decode())
                    out.append(row)
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names[: len(columns)]])

    return run


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, texts: bool = True,
) -> DataFrame:
    """Remove every word inside a run of `window` words that also starts in a smaller document.

    Returns a row per document: doc_id, n_words, n_removed, kept_sha256 and, with `texts`, the
    factors (start, length, source document, position there; in words), the removed spans and the
    kept words joined by spaces.  Documents are judged on the input.  A null or empty text has no
    words; texts of any length are parsed whole; rows with the same id don't remove from each
    other, whether their texts are the same or not, and each is parsed by itself; a document
    without an id keeps all its words and removes nothing; ids must be numbers; an empty table
    gives none; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows are known by their id and text: a text's hash tells those apart that share an id
    docs = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_key"), "text")
    row, same, window_key = ["doc_id", "text_key"], ["n_words", "s1", "s2"], ["h", "g"]
    profile = written(docs.dropna().mapInArrow(_profile(window, seed), "doc_id long, text_key long, n_words long, s1 long, s2 long, seeds array<long>"), "profile")
    # what is joined with all rows is written first: Spark splits a hot key only where a join reads
    # both sides straight from a shuffle, and one text or window may be a third of all
    first = written(profile.where(F.col("n_words") >= window).groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "classes")
    copies = written(profile.where(F.col("n_words") >= window).join(first, same).where("doc_id > first").select(*row, F.col("first").alias("copied")).distinct(), "copies")

    seeds = profile.join(copies, row, "left_anti").select(*row, F.explode("seeds").alias("h"))
    common = seeds.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h")
    held = written(seeds.join(written(common, "common"), "h").groupBy(*row).agg(F.collect_set("h").alias("seeds")), "seeds")
    near = Sieve(held).split(docs, "doc_id", True).join(held, row)
    stretches = written(near.mapInArrow(_indexed(window, seed), "doc_id long, text_key long, h array<long>, g array<long>, at array<int>"), "windows")
    windows = stretches.select(*row, F.explode(F.arrays_zip("h", "g", "at")).alias("w")).select(*row, "w.*")
    index = windows.groupBy(*window_key).agg(F.min("doc_id").alias("source"), F.min_by("at", "doc_id").alias("at"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    found = windows.drop("at").join(written(index, "index"), window_key).where("doc_id > source").groupBy(*row).agg(F.collect_set(F.struct("h", "g", "source", "at")).alias("windows"))
    dropped(profile)
    tidied(docs.sparkSession)
    touched = written(found.join(copies, row, "full").select(*row, "copied", "windows"), "touched")
    sieve = Sieve(touched)
    listed = "array<struct<h:bigint,g:bigint,source:bigint,at:int>>"
    none = sieve.split(docs, "doc_id", False).select("doc_id", "text", F.lit(None).cast("long").alias("copied"), F.lit(None).cast(listed).alias("windows"))
    some = sieve.split(docs, "doc_id", True).join(touched, row, "left").select("doc_id", "text", "copied", "windows")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + f", factors array<{FACTOR}>, spans array<struct<start:int,end:int>>, kept string" * texts
    return none.unionByName(some).mapInArrow(_parsed(window, texts), schema)
