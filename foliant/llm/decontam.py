"""Benchmark decontamination with suffix arrays over the training documents.

Each slice of documents is a shard with its own suffix array, made where the documents are
read: the sorted list of word places, compared by the words that follow.  The benchmark's
suffixes travel instead of the documents.  Every suffix of every test item is looked up in
every shard by binary search, which gives the places where its window occurs; places that
follow each other in item and document join to the longest verbatim matches.

Only suffixes that can still match are sorted: those whose first words all stand in the
benchmark, next to each other.  The benchmark goes to the executors in blocks of bounded size,
over the same read of the documents and without a shuffle: the driver holds one block while it
indexes it, and a task one block while it looks it up; the others wait on disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._text import ALNUM, Words, mix2, slices, view

WINDOW = 10
#: Bytes of benchmark text sent to the executors at once.
BLOCK_BYTES = 8 << 20

MATCH = "array<struct<item_id:string,doc_word:int,item_word:int,length:int>>"


@dataclass
class Block:
    """Part of the benchmark: its vocabulary and its distinct windows as sorted word ids.  Window k
    stands at the places first[k] to first[k + 1] of `item` and `place`."""

    window: int
    vocabulary: np.ndarray
    pairs: np.ndarray
    shortest: int
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    names: list[str]


def _keys(ids: np.ndarray, at: np.ndarray, length: np.ndarray, window: int, fill: int = 0) -> np.ndarray:
    """The words from each place as byte strings that sort like the sequences of words."""
    out = np.full((len(at), window), fill, ">u4")
    for k in range(window):
        take = length > k
        out[take, k] = ids[at[take] + k]
    return np.ascontiguousarray(out).view(f"S{4 * window}").ravel()


def index(items: list[tuple[str, str]], window: int = WINDOW) -> Block:
    """Items (id, text) as windows.  An item shorter than a window is one window."""
    data, off = view(pa.array([t for _, t in items], pa.string()))
    words = Words(data, off, ALNUM, fold=True)
    h, left, item = words.hashes(), words.left(), words.doc()
    vocabulary = np.unique(h)
    ids = np.append(np.searchsorted(vocabulary, h) + 1, np.zeros(window, np.int64)).astype(np.uint32)
    n = np.repeat(words.n, words.n)
    place = np.arange(len(h)) - np.repeat(words.first[:-1], words.n)
    at = np.flatnonzero((left >= window) | ((n < window) & (place == 0)))
    length = np.minimum(left[at], window)
    pairs = np.zeros(1 << 20, bool)
    within = np.flatnonzero(left > 1)
    pairs[_pair(h[within], h[within + 1])] = True
    # unused places of a short window are 0 below and the largest id above
    low = _keys(ids, at, length, window)
    high = _keys(ids, at, length, window, 0xFFFFFFFF)
    order = np.lexsort((place[at], item[at], length, low))
    low, high, length, at = low[order], high[order], length[order], at[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (length[1:] != length[:-1])
    return Block(window, vocabulary, pairs, int(length.min(initial=window)), low[new], high[new], length[new], np.append(np.flatnonzero(new), len(low)), item[at], place[at], [i for i, _ in items])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix2(a, b) & np.uint64((1 << 20) - 1)).astype(np.int64)


def matches(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where the block's windows occur: word places, and the windows' numbers."""
    h, left, w = words.hashes(), words.left(), block.window
    none = (np.zeros(0, np.int64),) * 2
    if not len(h) or not len(block.low):
        return none
    at = np.searchsorted(block.vocabulary, h)
    at[at == len(block.vocabulary)] = 0
    known = block.vocabulary[at] == h
    ids = np.append(np.where(known, at + 1, 0), np.zeros(w, np.int64)).astype(np.uint32)
    begins = known & (left >= block.shortest)
    if block.shortest > 1:
        both = np.zeros(len(h) + block.shortest, bool)
        both[: len(h) - 1] = known[:-1] & known[1:] & block.pairs[_pair(h[:-1], h[1:])]
        for k in range(block.shortest - 1):
            begins &= both[k : k + len(h)]
    suffix = np.flatnonzero(begins)
    keys = _keys(ids, suffix, np.minimum(left[suffix], w), w)
    order = np.argsort(keys, kind="stable")
    suffix, keys = suffix[order], keys[order]
    lo, hi = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    n = hi - lo
    hit = np.repeat(np.arange(len(n)), n)
    place = suffix[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else none[0]
    return place, hit


def _spread(window: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the places of the block where it stands: the window's index, and the place."""
    n = block.first[window + 1] - block.first[window]
    of = np.repeat(np.arange(len(window)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + block.first[window][of]


def joined(place: np.ndarray, item: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest matches: windows that follow each other in item and document, as one."""
    if not len(place):
        return place, item, at, length
    order = np.lexsort((place, place - at, item))
    place, item, at, length = place[order], item[order], at[order], length[order]
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (np.diff(place - at) != 0) | (np.diff(place) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return place[first], item[first], at[first], place[last] + length[last] - place[first]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list[Broadcast]:
    """The benchmark in blocks of at most about `block_bytes`; rows without id or text have no part."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    out = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        out.append(benchmark.sparkSession.sparkContext.broadcast(index(sorted((r.item, r.text) for r in part.collect()), window)))
    return out


def _loaded(blocks: list[Broadcast]) -> Iterator[Block]:
    """One block after the other; of several each is forgotten when the next one comes."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)  # it is read again from the executor's disk


def _parts(text: pa.Array) -> list[tuple[int, int, Words]]:
    """The documents of a batch in slices, with their words."""
    data, off = view(text)
    return [(i, j, Words(data, off[i : j + 1], ALNUM, fold=True)) for i, j in slices(off)]


def _covered(place: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edge = np.bincount(place, minlength=n + 1) - np.bincount(place + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _asked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def locate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Longest verbatim matches of benchmark items in each document.

    Returns a row per document: doc_id, n_words, n_hit (words inside a match) and matches
    (item_id, doc_word, item_word, length).  A null or empty text has no words; rows of `docs`
    that are alike are judged each; items that are alike all match; an empty benchmark or a
    null item matches nothing; other columns are not read.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _parts(batch.column(1))
            hit = [np.zeros(len(w.start), bool) for _, _, w in parts]
            doc, found = [np.zeros(0, np.int64)], [pa.array([], kind.value_type)]
            for block in _loaded(blocks):
                for (i, _, words), held in zip(parts, hit, strict=True):
                    at, of = matches(words, block)
                    held |= _covered(at, block.length[of], len(held))
                    which, k = _spread(of, block)
                    place, item, inside, length = joined(at[which], block.item[k], block.place[k], block.length[of][which])
                    d = np.searchsorted(words.first, place, "right") - 1
                    doc.append(d + i)
                    names = pa.array(block.names, pa.string()).take(pa.array(item))
                    numbers = (pa.array(x.astype(np.int32)) for x in (place - words.first[d], inside, length))
                    found.append(pa.StructArray.from_arrays([names, *numbers], fields=[*kind.value_type]))
            doc, found = np.concatenate(doc), pa.concat_arrays(found)
            order = np.argsort(doc, kind="stable")
            edge = pa.array(np.searchsorted(doc[order], np.arange(len(batch) + 1)), pa.int32())
            n = np.concatenate([w.n for _, _, w in parts]) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(_hits(parts, hit), pa.int64()), pa.ListArray.from_arrays(edge, found.take(pa.array(order)))], names=["doc_id", "n_words", "n_hit", "matches"])

    docs = _asked(docs, id_col, text_col)
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(f"n_words long, n_hit long, matches {MATCH}")]))


def _hits(parts: list[tuple[int, int, Words]], hit: list[np.ndarray]) -> np.ndarray:
    """How many words of each document are hit."""
    each = [np.bincount(w.doc()[held], minlength=len(w.n)) for (_, _, w), held in zip(parts, hit, strict=True)]
    return np.concatenate(each) if each else np.zeros(0, np.int64)


def report(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """What `locate` finds, as digests: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Rows are treated as by `locate`; an item's id counts once, whatever texts it has.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _parts(batch.column(1))
            hit = [np.zeros(len(w.start), bool) for _, _, w in parts]
            items: dict[int, set[str]] = {}
            for block in _loaded(blocks):
                for (i, _, words), held in zip(parts, hit, strict=True):
                    at, of = matches(words, block)
                    if not len(at):
                        continue
                    held |= _covered(at, block.length[of], len(held))
                    # each window once a document, then each item once a document
                    doc = np.searchsorted(words.first, at, "right") - 1
                    doc, of = np.divmod(np.unique(doc * len(block.low) + of), len(block.low))
                    which, k = _spread(of, block)
                    for d, x in zip(*(v.tolist() for v in np.divmod(np.unique(doc[which] * len(block.names) + block.item[k]), len(block.names))), strict=True):
                        items.setdefault(i + d, set()).add(block.names[x])
            n = np.concatenate([w.n for _, _, w in parts]) if parts else np.zeros(0, np.int64)
            hits = _hits(parts, hit)
            sums = [hashlib.sha256(",".join(sorted(items.get(d, ()))).encode()).hexdigest() for d in range(len(batch))]
            columns = [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(items.get(d, ())) for d in range(len(batch))], pa.int64()), pa.array(sums, pa.string()), pa.array(hits > 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    docs = _asked(docs, id_col, text_col)
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")]))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of `docs`, whole and in their columns, without those that hold a benchmark window."""
    blocks, k = _blocks(benchmark, item_col, item_text_col, window, block_bytes), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _parts(batch.column(k))
            clean = np.ones(len(batch), bool)
            for block in _loaded(blocks):
                for i, _, words in parts:
                    at, _ = matches(words, block)
                    clean[i + np.searchsorted(words.first, at, "right") - 1] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
