"""A quality classifier by nearest neighbours in a latent-semantic space.

Texts are bags of terms: their words, hashed to a fixed number of places, pairs of neighbouring
characters by kind, and a few terms for words that repeat.  The square roots of the terms' shares,
weighted by how few labelled texts have them, are projected on the leading singular vectors of a
bounded sample of labelled texts.  Those are found by subspace iteration: each pass over the sample
sums products on the executors, and only sums, and in the end the projected vectors, go to the
driver.  Every document is compared by cosine with all the labelled vectors, block by block as one
matrix product, and the nearest ones vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._shared import dropped, written
from foliant.llm._text import ALNUM, SLICE_BYTES, SPACE, Words, mix, mix2, slices, view
from foliant.llm.rules import _later

#: Labelled texts that are fitted and sent to the executors, at most (8192 x 32 floats, 1 MB).
SAMPLE = 8192
DIMENSIONS, NEIGHBOURS, SHARPNESS = 32, 25, 8
BLOCK = 256
#: Columns carried along while the singular vectors are found, passes over the sample, and tasks of a pass.
SKETCH, PASSES, TASKS = 48, 3, 8

_KIND = np.full(256, 29, np.uint8)
_KIND[0x80:] = 0
for _k, _chars in enumerate([b"a", b"e", b"i", b"o", b"u", b"bcdfghj", b"klmnpqr", b"stvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r", b".", b",", b";:", b"!", b"?", b"'\"", b"()[]{}", b"-_", b"/\\", b"|", b"#", b"*", b"$%", b"&", b"<>"], 1):
    _KIND[[*_chars]] = _k
KINDS, EXTRA, WORDS = 32, 4, 4096
PAIRS = KINDS * KINDS
TERMS = PAIRS + EXTRA + WORDS


def terms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares, a row per document of a slice."""
    data_off, words = off, Words(data, off, SPACE)
    off, n = words.off, len(off) - 1
    kind = _KIND[words.bytes].astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(off))
    after = np.full(len(kind), 30)
    after[:-1] = kind[1:]
    last = off[1:][np.diff(off) > 0] - 1
    after[last] = 31  # a text's end
    out = np.zeros((n, TERMS), np.float32)
    _shares(doc, kind * KINDS + after, out[:, :PAIRS])
    spoken = Words(data, data_off, ALNUM, fold=True)
    _shares(spoken.doc(), (mix(spoken.hashes()) & np.uint64(WORDS - 1)).astype(np.int64), out[:, PAIRS + EXTRA :])
    h, of = words.hashes(), words.doc()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    seen = _later(mix2(h, mix(np.arange(n, dtype=np.uint64))[of]))
    total = np.maximum(words.n, 1)
    upper = np.bincount(doc, kind == 9, minlength=n) / np.maximum(np.diff(off), 1)
    out[:, PAIRS] = np.sqrt(np.bincount(of[same], minlength=n) / total)
    out[:, PAIRS + 1] = np.sqrt(np.maximum(0, np.bincount(of[seen], minlength=n) / total - 0.5))
    out[:, PAIRS + 2] = np.sqrt(np.maximum(0, upper - 0.1))
    out[:, PAIRS + 3] = words.n == 0
    return out


def _shares(doc: np.ndarray, term: np.ndarray, out: np.ndarray) -> None:
    """Square roots of the terms' shares of each document; what isn't there stays 0."""
    n, most = out.shape
    at, counts = np.unique(doc * most + term, return_counts=True)
    of = at // most
    out[of, at - of * most] = np.sqrt(counts / np.bincount(doc, minlength=n)[of])


@dataclass
class Space:
    """The projection, the labelled vectors and their labels."""

    centre: np.ndarray
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    label: np.ndarray

    def weighed(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) * self.weight

    def project(self, x: np.ndarray) -> np.ndarray:
        v = self.weighed(x) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """The neighbours' labels, weighted by similarity; without any, one half."""
        k = min(NEIGHBOURS, len(self.label))
        if not k:
            return np.full(len(x), 0.5)
        out = np.empty(len(x))
        v = self.project(x)
        for a in range(0, len(v), BLOCK):
            cosine = v[a : a + BLOCK] @ self.vectors.T
            near = np.argpartition(cosine, len(self.label) - k, axis=1)[:, len(self.label) - k :]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(float) ** SHARPNESS
            out[a : a + BLOCK] = (w * self.label[near]).sum(1) / w.sum(1)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Labels and terms of (label, text) rows, a block at a time."""
    for batch in batches:
        data, off = view(batch.column(1))
        for i, j in slices(off, SLICE_BYTES, BLOCK):
            yield batch.column(0).slice(i, j - i), terms(data, off[i : j + 1])


def _summed(sample: DataFrame, each, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of each(terms of a block), of this shape, over the sample: a sum from each of at most TASKS tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _blocks(batches):
            total += each(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    total = np.zeros(shape)
    for r in sample.coalesce(TASKS).mapInArrow(run, "sum binary").toLocalIterator():
        total += np.frombuffer(r["sum"]).reshape(shape)
    return total


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(label, text) of at most `sample` labelled texts, chosen by the order of (hash of id, id, hash of text, label)."""
    labels = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().distinct()
    labels = labels.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).dropna()
    rows = docs.join(F.broadcast(labels), "_id").withColumn("_h", F.xxhash64("_text"))  # at most `sample` rows
    keys = rows.select("_id", "_h", "_label").distinct().orderBy(F.xxhash64("_id"), "_id", "_h", "_label").limit(sample)
    chosen = rows.join(F.broadcast(keys), ["_id", "_h", "_label"]).dropDuplicates(["_id", "_h", "_label"])
    return written(chosen.select("_label", "_text"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Space:
    """The space of the labelled texts with the smallest hashes of their ids, `sample` at most.

    Null labels, ids and texts have no part in it.  Rows that are alike count once; an id with
    several texts or labels takes part with each.  Without any labelled text the space is empty.
    Other columns are not read.
    """
    rows = _sampled(docs, labels, id_col, text_col, label_col, sample)
    first = _summed(rows, lambda x: np.stack([x.sum(0, dtype=float), (x > 0).sum(0), np.full(TERMS, len(x))]), (3, TERMS))
    n = int(first[2, 0])
    centre, weight = (first[0] / max(n, 1)).astype(np.float32), (np.log((1 + n) / (1 + first[1])) + 1).astype(np.float32)
    space = Space(centre, weight, np.zeros((TERMS, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    if n:
        space.axes = _axes(rows, space)
        got = rows.mapInArrow(_projected(space), "label int, v binary").toArrow()  # 128 bytes a labelled text
        label, v = got.column("label").to_numpy().astype(float), np.frombuffer(b"".join(x.as_py() for x in got.column("v")), np.float32).reshape(-1, DIMENSIONS)
        order = np.lexsort((label, *v.T))  # doesn't depend on the tasks that made them
        space.vectors, space.label = v[order], label[order]
    dropped(rows)
    return space


def _axes(rows: DataFrame, space: Space) -> np.ndarray:
    """The leading singular vectors of the weighed terms, by subspace iteration."""
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((TERMS, SKETCH)))[0]
    for k in range(PASSES):

        def each(x: np.ndarray, basis=basis.astype(np.float32)) -> np.ndarray:
            y = space.weighed(x)
            return (y.T @ (y @ basis)).astype(float)

        image = _summed(rows, each, (TERMS, SKETCH))
        if k < PASSES - 1:
            basis = np.linalg.qr(image)[0]
    within = basis.T @ image
    _, turn = np.linalg.eigh((within + within.T) / 2)
    return (basis @ turn[:, ::-1][:, :DIMENSIONS]).astype(np.float32)


def _projected(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([label, pa.array([v.astype(np.float32).tobytes() for v in space.project(x)], pa.binary())], names=["label", "v"])

    return run


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row of `docs`, or, with
    `keep`, those columns of the rows that score `least` or more.

    Null and empty texts share one vector, and so one score.  Rows that are alike, and rows
    without an id, are scored each; ids must be numbers; a text is read whole, whatever its length;
    an empty table gives none; other columns have no part in a score.  Of labelled texts that are
    equally near to the 25th neighbour any may vote.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)
    at = docs.columns.index(text_col)
    ids = docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            text = batch.column(at)
            data, off = view(text)
            found = [space.vote(terms(data, off[i : j + 1])) for i, j in slices(off, SLICE_BYTES, BLOCK)]
            found = np.concatenate(found) if found else np.zeros(0)
            if keep is not None:
                yield batch.filter(pa.array(found >= least)).select(keep)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(ids).cast(pa.int64()), pa.array(found)], names=["doc_id", "score"])

    if keep is not None:
        return docs.mapInArrow(run, T.StructType([T.StructField(c, docs.schema[c].dataType, True) for c in keep]))
    return docs.mapInArrow(run, "doc_id long, score double")
