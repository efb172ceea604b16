"""Toxicity by a linear-chain conditional random field over the words of a text.

The chain has two states, plain and toxic.  A word's features are its hash and those of its
first bytes, so that forms of one stem share weight.  Only features that stand out in toxic
training texts have weights.  Words of toxic training texts that carry
such a feature are the labelled tokens that the chain is trained on, together with all words of
the clean ones, by gradient ascent on the likelihood.

Forward and backward messages are ratios of the two states, and a step from word to word is a
Moebius map.  A slice of documents is one long chain that is reset at each document: blocks of
it are composed side by side, their maps joined, and then run side by side from their known
beginnings.  The marginals of the words give a document's score, and the runs of likely toxic
words their places in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._text import ALNUM, Words, mix, mix2, runs, slices, view

#: Labelled texts used to learn, at most; those with the smallest hashes of their ids.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 3000
#: Bytes of these texts, which are whole: each label's draw ends before it exceeds half of them.
LEARN_BYTES = 1 << 25
PREFIXES = (4, 5, 6, 7)
STEPS, RATE, RIDGE = 30, 0.3, 1e-3
BLOCK = 256


def features(words: Words) -> np.ndarray:
    """A row of feature hashes per word: the word, and its prefixes (0 where it is no longer)."""
    length = words.end - words.start
    out = np.zeros((len(length), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = words.hashes()
    for k, n in enumerate(PREFIXES, 1):
        long = length > n
        out[long, k] = mix(words.hashes(n)[long] + np.uint64(n))
    return out


def _forward(psi: np.ndarray, first: np.ndarray, a: np.ndarray, start: float) -> np.ndarray:
    """Ratios of the forward messages; first: whether a word begins its document."""
    n = len(psi)
    if not n:
        return np.zeros(0)
    m = -(-n // BLOCK)
    p = np.ones(m * BLOCK)
    f = np.zeros(m * BLOCK, bool)
    p[:n], f[:n] = psi, first
    p, f = np.ascontiguousarray(p.reshape(m, BLOCK).T), np.ascontiguousarray(f.reshape(m, BLOCK).T)
    # the map of a whole block: r -> (u r + v) / (x r + y)
    u, v, x, y = np.ones(m), np.zeros(m), np.zeros(m), np.ones(m)
    for k in range(BLOCK):
        q = p[k]
        u, v, x, y = q * (a[1, 1] * u + a[0, 1] * x), q * (a[1, 1] * v + a[0, 1] * y), a[1, 0] * u + a[0, 0] * x, a[1, 0] * v + a[0, 0] * y
        if f[k].any():
            reset = f[k]
            u, v = np.where(reset, 0, u), np.where(reset, q * start, v)
            x, y = np.where(reset, 0, x), np.where(reset, 1, y)
        size = np.maximum(np.maximum(np.abs(u), np.abs(v)), np.maximum(np.abs(x), np.abs(y)))
        u, v, x, y = u / size, v / size, x / size, y / size
    r, at = np.empty(m), 1.0
    for k, (b, c, d, e) in enumerate(zip(u.tolist(), v.tolist(), x.tolist(), y.tolist(), strict=True)):
        r[k] = at
        at = (b * at + c) / (d * at + e)
    out = np.empty((BLOCK, m))
    for k in range(BLOCK):
        r = p[k] * np.where(f[k], start, (a[1, 1] * r + a[0, 1]) / (a[1, 0] * r + a[0, 0]))
        out[k] = r
    return out.T.ravel()[:n]


def marginals(logit: np.ndarray, begin: np.ndarray, a: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each word, and the forward and backward ratios.  begin: first word of each
    document that has words; a: the transitions' weights; start: the ratio before any word."""
    n = len(logit)
    psi = np.exp(np.clip(logit, -30, 30))
    first = np.zeros(n, bool)
    first[begin] = True
    forward = _forward(psi, first, a, start)
    # backward messages are forward ones of the chain read from its end: with g = psi * b,
    # g at a word is psi * (a10 + a11 g') / (a00 + a01 g'), and psi itself at a document's end
    last = np.zeros(n, bool)
    last[np.append(begin[1:], n)[: len(begin)] - 1] = True
    g = _forward(psi[::-1], last[::-1], a.T, 1.0)[::-1]
    b = g / psi
    return forward * b / (1 + forward * b), forward, g


@dataclass
class Chain:
    """Weights of the features (sorted hashes), the bias, transitions, start, and calibration."""

    key: np.ndarray
    weight: np.ndarray
    bias: float
    a: np.ndarray
    start: float
    calibration: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if len(self.key):
            for k in range(x.shape[1]):
                at = np.minimum(np.searchsorted(self.key, x[:, k]), len(self.key) - 1)
                out += np.where(self.key[at] == x[:, k], self.weight[at], 0)
        return out

    def tag(self, words: Words) -> np.ndarray:
        begin = words.first[:-1][words.n > 0]
        return marginals(self.logits(features(words)), begin, self.a, self.start)[0]

    def score(self, m: np.ndarray, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-(summary(m, words) @ self.calibration)))


def summary(m: np.ndarray, words: Words) -> np.ndarray:
    """What a document's score is made of: its largest marginal, and how many words it expects."""
    n = len(words.n)
    doc = words.doc()
    top = np.zeros(n)
    np.maximum.at(top, doc, m)
    likely = np.bincount(doc, np.where(m > 0.3, m, 0), minlength=n)
    return np.column_stack([np.ones(n), top, np.log1p(likely), likely / np.maximum(words.n, 50) * 50])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE, learn_bytes: int = LEARN_BYTES,
) -> Chain:
    """The chain trained on a bounded sample of the labelled texts; null labels, ids and texts
    have no part in it.  Texts are drawn whole, whatever their length, and at least one a label;
    rows that are alike count each; other columns are not read.  With texts of one label only, or
    none, the chain has no features and every text the same score."""
    labels = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    rows = []
    counts = {r._label: r.n for r in labels.groupBy("_label").agg(F.count("*").alias("n")).collect() if r._label in (0, 1)}
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).dropna()
    take = [labels.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, toxic_sample), (0, clean_sample))]
    sizes = texts.select("_id", F.octet_length("_text").alias("_size")).join(F.broadcast(take[0].unionByName(take[1])), "_id")
    sizes = sizes.groupBy("_label", "_id").agg(F.sum("_size").alias("_size")).orderBy(F.xxhash64("_id"), "_id").collect()
    drawn = []
    for y in (1, 0):
        held = 0
        for k, r in enumerate(r for r in sizes if r._label == y):
            held += r._size
            if k and held > learn_bytes // 2:
                break
            drawn.append((r._id, y))
    drawn = docs.sparkSession.createDataFrame(drawn, "_id long, _label int")
    # at most toxic_sample + clean_sample rows
    rows = texts.join(F.broadcast(drawn), "_id").select("_id", "_text", "_label").toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    return train([(t.as_py(), y.as_py()) for t, y in zip(rows.column("_text"), rows.column("_label"), strict=True)], counts)


def train(rows: list[tuple[str, int]], counts: dict[int, int] | None = None) -> Chain:
    """rows: (text, 0 or 1); counts: how many of each label the rows were drawn from."""
    a = np.array([[1.0, 1.0], [1.0, 1.0]])
    label = np.array([y for _, y in rows], int)
    if not len(rows) or label.min() == label.max():
        share = float(np.clip(label.mean() if len(label) else 0, 0.01, 0.99))
        return Chain(np.zeros(0, np.uint64), np.zeros(0), -5.0, a, 1.0, np.array([np.log(share / (1 - share)), 0, 0, 0]))
    counts = counts or {}
    each = np.where(label == 1, max(1, counts.get(1, 0) / max(1, (label == 1).sum())), max(1, counts.get(0, 0) / max(1, (label == 0).sum())))
    data, off = view(pa.array([t for t, _ in rows], pa.string()))
    cut = [*slices(off)]

    def parts() -> Iterator[tuple[Words, slice]]:
        for i, j in cut:
            yield Words(data, off[i : j + 1], ALNUM, fold=True), slice(i, j)

    # in how many texts of either label each feature occurs, if in two toxic ones at least
    total = np.array([each[label == y].sum() for y in (0, 1)])

    def texts(words: Words, held: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The features of these texts, once each a text."""
        x = features(words)
        doc = np.repeat(words.doc(), x.shape[1])
        flat = x.ravel()
        take = (flat > 0) & held[doc]
        if known is not None:
            take &= np.isin(flat, known)
        doc, flat = doc[take], flat[take]
        return flat[np.unique(mix2(flat, mix(doc.astype(np.uint64))), return_index=True)[1]]

    key, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for words, s in parts():
        found, n = np.unique(texts(words, label[s] == 1), return_counts=True)
        key, of = np.unique(np.concatenate([key, found]), return_inverse=True)
        seen = np.bincount(of, np.concatenate([seen, n]), minlength=len(key)).astype(np.int64)
    key, seen = key[seen >= 2], seen[seen >= 2]
    clean = np.zeros(len(key))
    for words, s in parts():
        found, n = np.unique(texts(words, label[s] == 0, key), return_counts=True)
        clean[np.searchsorted(key, found)] += n
    toxic, clean = seen * each[label == 1][0], clean * each[label == 0][0]
    share = total[1] / total.sum()
    precision = toxic / (toxic + clean)
    # evidence: in three toxic texts or more, and far more often than chance would have it
    evidence = (seen >= 3) & (toxic / (toxic + clean + 1) > 0.5 + share / 2)
    order = np.flatnonzero(precision > 2 * share)
    key, strong, odds = key[order], evidence[order], np.log((toxic[order] + 0.1) / (clean[order] + 0.5))
    weight = np.where(strong, np.clip(odds, 0, 3), 0)

    # a few bytes a word: the features' numbers, the labels, and where documents begin, part by part
    seen_parts = []
    for words, s in parts():
        x = features(words)
        place = np.minimum(np.searchsorted(key, x), max(0, len(key) - 1))
        place = np.where(key[place] == x, place, len(key)) if len(key) else np.zeros(x.shape, np.int64)
        y = np.append(strong, False)[place].any(1) & (label[s][words.doc()] == 1)
        begin = words.first[:-1][words.n > 0]
        first = np.zeros(len(y), bool)
        first[begin] = True
        seen_parts.append((place.astype(np.int32), y, begin, np.flatnonzero(~first[1:])))
    # parameters: weights, bias, the three free transitions, the start; Adam on the mean likelihood
    n, size = len(weight), max(1, sum(int(y.sum()) for _, y, _, _ in seen_parts))
    tokens = max(1, sum(len(y) for _, y, _, _ in seen_parts))
    theta = np.concatenate([weight, [np.log(max(sum(int(y.sum()) for _, y, _, _ in seen_parts) / tokens, 1e-6)), 0, 0, 0, 0]])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w = np.append(theta[:n], 0)
        a = np.exp(np.array([[0, theta[n + 1]], [theta[n + 2], theta[n + 3]]]))
        slope = np.zeros_like(theta)
        slope[:n] = -RIDGE * size * theta[:n]
        for ids, y, begin, follow in seen_parts:
            logit = sum(w[ids[:, k]] for k in range(ids.shape[1])) + theta[n]
            m, forward, g = marginals(logit, begin, a, float(np.exp(theta[n + 4])))
            left = y - m
            slope[:n] += sum(np.bincount(ids[:, k], left, minlength=n + 1) for k in range(ids.shape[1]))[:n]
            slope[n] += left.sum()
            if len(follow):
                f, b = forward[follow], g[follow + 1]
                cells = [a[0, 1] * b, f * a[1, 0], f * a[1, 1] * b]
                size_of = a[0, 0] + sum(cells)
                pair = np.bincount(y[follow].astype(int) * 2 + y[follow + 1], minlength=4)
                slope[n + 1 : n + 4] += pair[1:] - [(c / size_of).sum() for c in cells]
            slope[n + 4] += (y[begin] - m[begin]).sum()
        slope /= size
        mean, square = 0.8 * mean + 0.2 * slope, 0.95 * square + 0.05 * slope**2
        theta += RATE * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-4)
    keep = np.abs(theta[:n]) > 1e-3
    a = np.exp(np.array([[0, theta[n + 1]], [theta[n + 2], theta[n + 3]]]))
    chain = Chain(key[keep], theta[:n][keep], float(theta[n]), a, float(np.exp(theta[n + 4])), np.zeros(4))
    z = np.concatenate([summary(chain.tag(words), words) for words, _ in parts()])
    chain.calibration = _logistic(z, label, each)
    return chain


def _logistic(z: np.ndarray, y: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    beta = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (each * p * (1 - p))[:, None]).T @ z + np.eye(len(beta))
        step = np.linalg.solve(h, z.T @ (each * (y - p)) - beta)
        beta += np.clip(step, -2, 2)
    return beta


SPANS = "array<struct<start:int,end:int,probability:double>>"


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and spans of every row of `docs`.

    spans: runs of words whose marginal is over `least`, as code points from the text's start,
    with their largest marginal.  Null and empty texts get the score of a text without words.
    Rows that are alike, and rows without an id, are scored each, texts of any length whole; ids
    must be numbers; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            data, off = view(batch.column(1))
            for i, j in slices(off):
                words = Words(data, off[i : j + 1], ALNUM, fold=True)
                m = chain.tag(words)
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                if (m > least).any():
                    points = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])
                    doc = words.doc()
                    for a, b in zip(*(x.tolist() for x in runs(m > least)), strict=True):
                        for d in range(doc[a], doc[b - 1] + 1):  # a run may go over a document's end
                            s, e = max(a, words.first[d]), min(b, words.first[d + 1])
                            if s < e:
                                base = points[words.off[d]]
                                spans[d].append({"start": points[words.start[s]] - base, "end": points[words.end[e - 1]] - base, "probability": m[s:e].max()})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(chain.score(m, words)), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, score double, spans {SPANS}")
