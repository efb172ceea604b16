"""Quality rules: a decision list learned from labelled statistics of whole texts.

Sequential covering makes one rule after the other for rejecting documents.  A rule grows on
two thirds of the labelled rows, by the threshold that gains most information each time, and is
pruned on the other third by dropping its last conditions while that doesn't harm its
precision there.  The list is a Spark expression, CASE WHEN rule THEN false ... ELSE true END,
and reads as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import written
from foliant.llm._text import SPACE, Words, grams, mix, mix2, slices, span_hashes, view

#: Labelled rows used to learn, at most; those with the smallest hashes of their ids.
SAMPLE = 20_000
MOST_RULES, MOST_CONDITIONS, PRECISION = 12, 3, 0.9
SPAN = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_same_next", "n_distinct"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _repeats(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _later(key: np.ndarray) -> np.ndarray:
    """Whether each value occurred before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order][1:] == key[order][:-1]
    return out


def measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each document of a slice."""
    words = Words(data, off, SPACE)
    raw, off, n = words.bytes, words.off, len(off) - 1

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[off[1:]] - total[off[:-1]]

    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    doc, h = words.doc(), words.hashes()
    chars = np.bincount(doc, points[words.end] - points[words.start], minlength=n)
    # lines: from a document's begin or a line feed to the next
    feed = np.flatnonzero(raw == 0x0A)
    begin = np.sort(np.concatenate([off[:-1], feed + 1]))
    end = np.sort(np.concatenate([off[1:], feed]))
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(off, feed, "right") - 1]))
    held = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end, line_doc = begin[held], end[held], line_doc[held]
    salt = mix(np.arange(n, dtype=np.uint64))
    dup = _later(mix2(span_hashes(raw, begin, end), salt[line_doc]))
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) >= SPAN:
        at = np.flatnonzero(words.left()[: len(h) - SPAN + 1] >= SPAN)
        twice = at[_repeats(mix2(grams(h, SPAN)[at], salt[doc[at]]))]
        np.add.at(again, twice, 1)
        np.add.at(again, twice + SPAN, -1)
    covered = np.cumsum(again[:-1]) > 0
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    fresh = ~_later(mix2(h, salt[doc]))
    return [
        words.n, chars, within(_SYMBOL[raw]), np.bincount(line_doc[dup], minlength=n), np.bincount(doc[covered], minlength=n),
        np.bincount(line_doc, minlength=n), within(_UPPER[raw]), within(_PUNCT[raw]), np.bincount(doc[same], minlength=n), np.bincount(doc[fresh], minlength=n),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the COUNTS of every row, of its whole text; null counts as empty, all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = view(batch.column(1))
            for i, j in slices(off):
                columns = [pa.array(x.astype(np.int64)) for x in measure(data, off[i : j + 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", *COUNTS])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: What the rules speak of: names and their expressions over the counts.
RATIOS = {
    "n_words": "n_words", "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words", "upper_share": "n_upper / word_chars", "punct_per_word": "n_punct / n_words",
    "same_next_share": "n_same_next / n_words", "distinct_share": "n_distinct / n_words", "words_per_line": "n_words / n_lines",
}


def ratio(name: str) -> Column:
    """A ratio over nothing is 0."""
    top, _, below = RATIOS[name].partition(" / ")
    if not below:
        return F.col(top).cast("double")
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    at: float

    def column(self) -> Column:
        return ratio(self.name) > self.at if self.above else ratio(self.name) <= self.at

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.at:.6g}"


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[tuple[int, Condition, np.ndarray]]:
    held, out = np.ones(len(x), bool), []
    while len(out) < MOST_CONDITIONS:
        p, n = bad[held].sum(), (~bad[held]).sum()
        if not p or not n:
            break
        best = (0.0, None)
        for k, name in enumerate(names):
            values = np.unique(np.quantile(x[held, k], np.linspace(0, 1, 65)))
            cuts = (values[1:] + values[:-1]) / 2
            for above in (True, False):
                for cut in cuts:
                    take = held & ((x[:, k] > cut) == above)
                    q, m = bad[take].sum(), (~bad[take]).sum()
                    if q and (gain := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > best[0]:
                        best = (gain, (k, Condition(name, above, float(cut)), (x[:, k] > cut) == above))
        if best[1] is None:
            break
        out.append(best[1])
        held &= best[1][2]
    return out


def learn(x: np.ndarray, good: np.ndarray, names: list[str], order: np.ndarray) -> list[list[Condition]]:
    """Rules that reject, in order.  `order` is a permutation that splits rows to grow and prune."""
    bad, left = ~good, np.ones(len(x), bool)
    grows = order % 3 != 0
    rules: list[list[Condition]] = []
    while len(rules) < MOST_RULES and (bad & left & grows).sum() >= 3:
        g, p = left & grows, left & ~grows
        found = [c for _, c, _ in _grow(x[g], bad[g], names)]
        best, kept = -1.0, []
        for size in range(len(found), 0, -1):
            take = p & covers(x, found[:size], names)
            q, m = bad[take].sum(), (~bad[take]).sum()
            if q and q / (q + m) >= best:
                best, kept = q / (q + m), found[:size]
        if not kept or best < PRECISION:
            break
        rules.append(kept)
        left &= ~covers(x, kept, names)
    return rules


def covers(x: np.ndarray, rule: list[Condition], names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= (x[:, names.index(c.name)] > c.at) == c.above
    return out


def expression(rules: list[list[Condition]]) -> Column:
    """True for documents that no rule rejects."""
    out = None
    for rule in rules:
        met = rule[0].column()
        for c in rule[1:]:
            met = met & c.column()
        out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> list[list[Condition]]:
    """The decision list for labels 0 and 1, from `sample` rows at most, those with the smallest
    hashes of their ids.  Null labels and ids have no part in it; without rows there are no rules."""
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_label")).dropna().distinct()
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)
    # an id may have several texts or labels: rows that differ count each, `sample` of all at most
    rows = counted.join(F.broadcast(labels), "doc_id").select("doc_id", "_label", *(ratio(r).alias(f"_{r}") for r in RATIOS)).distinct()
    rows = rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(sample).toArrow()
    if not rows.num_rows:
        return []
    names = [*RATIOS]
    x = np.column_stack([rows.column(f"_{r}").to_numpy() for r in names])
    ids = rows.column("doc_id").to_numpy()
    order = np.empty(len(ids), np.int64)
    order[np.argsort(mix(ids.view(np.uint64)), kind="stable")] = np.arange(len(ids))
    return learn(x, rows.column("_label").to_numpy() == 1, names, order)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the COUNTS, base_failed and kept, a row for every row of `docs`.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows of eight.  kept:
    neither that nor rejected by the rules learned from `labels`.  Null texts count as empty.
    Rows that are alike, and rows without an id, are judged each; texts of any length are counted
    whole; ids must be numbers; an empty table gives none; other columns are not read.
    """
    counted = written(statistics(docs, id_col, text_col), "statistics")
    rules = fit(counted, labels)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & expression(rules))
