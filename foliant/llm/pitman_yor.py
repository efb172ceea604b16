"""A hierarchical Pitman-Yor language model, sampled by Gibbs sweeps over a distributed vocabulary.

Each word has a restaurant for what follows it, which seats every training token; the context of
a text's first word is the end of a text.  Their new tables are the customers of one restaurant
of words, and a new table there draws its word from a model of its letters: restaurants for each
context of two letters, which share the restaurants of one letter as parents, these the restaurant
of no context, and that the uniform distribution.  A word that no training text has is the event
"unknown word", as it is for an add-one model over the same tokens: its probability is what new
tables have, less what the letters give the words that are known, so that known words and the
unknown one share a mass of 1.

All pairs of words are counted, and each is a dish of its own in the restaurant of its first word.
A pair that occurs once has one table whatever the seating, so there is nothing to sample: what
such pairs add to the counts of tables and customers follows from the counts of words.  To score a
text they are needed one by one.  A training text has them itself, as any pair of it that doesn't
repeat is one of them; for other texts they are looked up like the pairs that repeat.

A sweep seats each word (or pair of words) anew, given the tables of all others: with c customers and weight
w = (strength + discount * tables) * P(word by letters), it draws t tables with probability
proportional to S(c, t) * w^t, S being generalised Stirling numbers.  The draw depends on the
word's hash and the sweep alone, so a sweep is one pass over the vocabulary without state, and
a pass repeated after a lost executor gives the same seating.  Letters of the tables are summed
(at most 257^3 sums, however large the corpus) and their restaurants seated on the driver.
The probability of a word by itself is the mean over the sweeps after burning in.  Pairs are
seated in turn with the words: at one table each at first, then by the words' probabilities.

A text's score is the sum of what each word has by back-off, as a word and as a context, and of
what the pairs seen in training add to that.

Counts cover all training documents.  The most frequent words, a fixed number, are numbered by
their frequency, and these numbers stand for them in pairs; other words go by their hash.  Frequent
words and pairs go to the executors with their probabilities; all others are joined, so that no
join has a hot key.  Pairs to be counted, and what texts ask of words and pairs, go through shuffles
in packets by hash, and are counted and looked up there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import _packets
from foliant.llm._packets import buckets, dealt, packed, place, unpacked, whole
from foliant.llm._shared import Sieve, dropped, tidied, written
from foliant.llm._text import SPACE, Words, mix, mix2, slices, view

#: Sweeps over the words after each seating of the pairs; and those after the last one, whose mean counts.
BURN_IN, SWEEPS = 1, 2
#: Words and pairs sent to the executors: the most frequent ones, at most so many.
FREQUENT, FREQUENT_PAIRS = 1 << 18, 1 << 21
#: Distinct words, and tokens, that a task counts before it passes them on.
HELD_WORDS, HELD_TOKENS = 1 << 18, 1 << 20
#: What a task asks for, or has of answers, before it passes that on.
HELD_ASKED = 1 << 19
#: Letters that a task holds before it counts them, and rows that go to the JVM at once.
HELD_LETTERS, SENT = 1 << 19, 1 << 16
#: Times that pairs are seated anew.
PAIR_SWEEPS = 1
#: What an occurrence in texts to be scored adds to a pair's count while pairs are counted.
ASKED = 1 << 40
#: Kinds of packets: pairs of two frequent words and others, while pairs are counted; and while texts are scored
#: what is known of pairs and words, what is looked up (pairs, words, pairs that may occur once and have rare
#: words, those words), answers (of pairs, of words, for pairs with rare words), and texts.
NEAR, FAR = 0, 1
KNOWN_PAIR, KNOWN_WORD, ASK_PAIR, ASK_WORD, ASK_SPLIT, ASK_SIDE, OF_PAIR, OF_WORD, OF_SPLIT, TEXT = range(10)
LETTER_DISCOUNT, LETTER_STRENGTH, WORD_STRENGTH = 0.5, 1.0, 1.0
PAIR_STRENGTH = 1.0
EXACT = 64
EDGE = 256  # the symbol before a word's first byte and after its last
A = 257


def stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log S(c, t) for c, t up to n, of the recursion S(c+1, t) = S(c, t-1) + (c - d t) S(c, t)."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(n + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, n):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - d * t[1:], 0)))
    return out


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but their key."""
    x = mix(key.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def seat(c: np.ndarray, weight: np.ndarray, d: float, u: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Tables for c customers each, by the weight of a new table; exact up to EXACT customers,
    beyond that seated in blocks that double, with a Poisson number of new tables in all."""
    t = np.minimum(c, 1).astype(np.int64)
    small = np.minimum(c, EXACT)
    order = np.argsort(small, kind="stable")
    values, first = np.unique(small[order], return_index=True)
    for k, v in enumerate(values):
        if v < 2:
            continue
        rows = order[first[k] : first[k + 1] if k + 1 < len(first) else None]
        logit = table[v, 1 : v + 1] + np.log(weight[rows])[:, None] * np.arange(1, v + 1)
        p = np.exp(logit - logit.max(1, keepdims=True)).cumsum(1)
        t[rows] = 1 + (p < (u[rows] * p[:, -1])[:, None]).sum(1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        w, n = weight[large], c[large]
        mean, a, at = np.zeros(len(large)), float(EXACT), t[large].astype(float)
        while (n > a).any():
            b = np.minimum(2 * a, np.maximum(n, a))
            new = w * np.log((w + b - d * at) / (w + a - d * at))
            mean, at, a = mean + new, at + new, 2 * a
        v = uniform((u[large] * (1 << 53)).astype(np.uint64), 99)
        z = 1.702**-1 * np.log(v / (1 - v))  # close to a normal deviate
        t[large] += np.rint(np.maximum(0, mean + np.sqrt(mean) * z)).astype(np.int64)
    return np.minimum(t, c)


@dataclass
class Letters:
    """Predictive probabilities of a letter after two: seen ones by key, the rest by back-off."""

    key: np.ndarray
    p: np.ndarray
    back: np.ndarray
    one: np.ndarray

    def log10(self, symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
        a, b = _before(symbols, start)
        pair = a * A + b
        p = self.back[pair] * self.one[b * A + symbols]
        if len(self.key):
            key = pair * A + symbols
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            seen = self.key[at] == key
            p[seen] = self.p[at[seen]]
        return np.add.reduceat(np.log10(p), start) if len(start) else np.zeros(0)


def _before(symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.roll(symbols, 1)
    a = np.roll(symbols, 2)
    b[start] = EDGE
    a[start] = EDGE
    a[np.minimum(start + 1, len(symbols) - 1)] = EDGE
    return a, b


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words, each ended by EDGE, one word after the other, and where each starts."""
    n = end - start
    first = np.concatenate([[0], np.cumsum(n + 1)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    out = np.full(int(n.sum() + len(n)), EDGE, np.int64)
    inner = np.ones(len(out), bool)
    inner[first + n] = False
    out[inner] = data[np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else start, n) + np.arange(n.sum())]
    return out, first


def fit_letters(key: np.ndarray, c: np.ndarray, previous: Letters | None, sweep: int) -> Letters:
    """Seat the letters of the tables of words: contexts of two, one and no letters in turn."""
    d, s = LETTER_DISCOUNT, LETTER_STRENGTH
    table = stirling(d)

    def level(key: np.ndarray, c: np.ndarray, parent: np.ndarray, context: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
        n = np.bincount(context, c, minlength=int(context.max()) + 1) if len(context) else np.zeros(1)
        guess = np.bincount(context, minlength=len(n))  # one table a letter, at first
        for k in range(2):
            t = seat(c, (s + d * guess[context]) * parent, d, uniform(key, salt + k), table)
            guess = np.bincount(context, t, minlength=len(n))
        return t, n, guess

    one_key, one_of = np.unique(key % (A * A), return_inverse=True)
    none_key, none_of = np.unique(one_key % A, return_inverse=True)
    flat = np.full(A, 1 / A)
    parent2 = previous.one[key % (A * A)] if previous else np.full(len(key), 1 / A)
    t2, n2, tables2 = level(key, c, parent2, key // A, sweep * 10)
    c1 = np.bincount(one_of, t2, minlength=len(one_key)).astype(np.int64)
    t1, n1, tables1 = level(one_key, c1, flat[one_key % A], one_key // A, sweep * 10 + 3)
    c0 = np.bincount(none_of, t1, minlength=len(none_key)).astype(np.int64)
    t0, n0, tables0 = level(none_key, c0, flat[none_key], none_key * 0, sweep * 10 + 6)
    zero = (s + d * tables0[0]) / (s + n0[0]) * flat
    zero[none_key] += (c0 - d * t0) / (s + n0[0])

    def wide(x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([x, np.zeros(n - len(x))])

    n1, tables1 = wide(n1, A), wide(tables1, A)
    one = ((s + d * tables1) / (s + n1))[:, None] * zero[None, :]
    one = one.ravel()
    one[one_key] += (c1 - d * t1) / (s + n1[one_key // A])
    n2, tables2 = wide(n2, A * A), wide(tables2, A * A)
    back = (s + d * tables2) / (s + n2)
    p = (c - d * t2) / (s + n2[key // A]) + back[key // A] * one[key % (A * A)]
    return Letters(key, p, back, one)


class Slots:
    """Longs other than 0 to be found fast: each has one of two places in a table.  Those that find
    both taken are left out: `placed` says which are in."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys) - 1).bit_length())
        self.mask, self.keys, self.number = (1 << bits) - 1, np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int32)
        self.placed = np.zeros(len(keys), bool)
        for shift in (0, 31):
            rows = np.flatnonzero(~self.placed)
            slot = (keys[rows] >> shift) & self.mask
            slot, first = np.unique(slot, return_index=True)
            free = self.keys[slot] == 0
            slot, rows = slot[free], rows[first[free]]
            self.keys[slot], self.number[slot], self.placed[rows] = keys[rows], rows, True

    def find(self, x: np.ndarray) -> np.ndarray:
        """The number of each, -1 for those that aren't in."""
        slot = x & self.mask
        out = np.where(self.keys[slot] == x, self.number[slot], -1)
        rest = np.flatnonzero(out < 0)
        slot = (x[rest] >> 31) & self.mask
        out[rest] = np.where(self.keys[slot] == x[rest], self.number[slot], -1)
        return out


class Ranks:
    """Keys of words: 1, 2, ... for frequent words, beginning with the most frequent one; hashes for others."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        self.slots = Slots(h[np.lexsort((h, -n))])
        self.most = len(h)

    def keys(self, h: np.ndarray) -> np.ndarray:
        h = h.view(np.int64)
        no = self.slots.find(h)
        far = np.where((h >= 0) & (h <= self.most), h | 1 << 62, h)
        return np.where(no >= 0, no + 1, far)


@dataclass
class Model:
    """Seatings after each sweep, (tables in all, letters), of which the last `kept` count, with the corpus's counts.

    `customers` and `end_customers` are those of the restaurant of words; `pairs` is a table
    (a, b, c, t) of contexts, words, customers and tables, of which the driver has the plan only;
    of pairs that occur once it may have those alone that texts to be scored ask for.
    `end_room` is the weight of back-off after the end of a text.
    """

    tokens: int
    types: int
    ends: int
    discount: float
    states: list[tuple[int, Letters]]
    customers: int = 0
    end_customers: int = 0
    end_room: float = PAIR_STRENGTH
    pair_discount: float = 0.5
    kept: int = 1
    ranks: Ranks | None = field(default=None, repr=False)
    pairs: DataFrame | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "pairs": None, "ranks": None}

    def new(self, tables: int) -> float:
        """Mass of new tables."""
        return WORD_STRENGTH + self.discount * tables

    def spelling(self, state: int, symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The weight of a new table with each word, after a sweep."""
        t, letters = self.states[state]
        return self.new(t) * 10 ** letters.log10(symbols, start)

    def base(self, symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Mean probability of drawing words by letters at a new table, new mass included."""
        return self._mean([self.spelling(k, symbols, start) for k in self._kept()])

    def _kept(self) -> range:
        return range(len(self.states) - self.kept, len(self.states))

    def _mean(self, weights: list[np.ndarray]) -> np.ndarray:
        return sum(weights) / self.kept / (WORD_STRENGTH + self.customers)

    def tables(self, sweep: int, h: np.ndarray, c: np.ndarray, symbols: np.ndarray, start: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The seating of a sweep, given the state after the one before."""
        return self._seated(sweep, h, c, self.spelling(sweep - 1, symbols, start), table)

    def _seated(self, sweep: int, h: np.ndarray, c: np.ndarray, weight: np.ndarray, table: np.ndarray) -> np.ndarray:
        return seat(c, np.maximum(weight, 1e-300), self.discount, uniform(h.view(np.uint64), 1000 + sweep), table)

    def unknown(self, known: float) -> float:
        """Probability of any unknown word, `known` being the sum of `base` over the vocabulary."""
        return max(sum(self.new(t) for t, _ in self.states[-self.kept :]) / self.kept / (WORD_STRENGTH + self.customers) - known, 1e-12)

    def probability(self, h: np.ndarray, c: np.ndarray, symbols: np.ndarray, start: np.ndarray, table: np.ndarray) -> np.ndarray:
        return self.priced(h, c, symbols, start, table)[0]

    def priced(self, h: np.ndarray, c: np.ndarray, symbols: np.ndarray, start: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each word by itself, and the part of it that is drawn by letters (`base`)."""
        kept = self._kept()
        weights = [self.spelling(k, symbols, start) for k in range(kept.start - 1, kept.stop)]
        seats = sum(self._seated(k, h, c, w, table) for k, w in zip(kept, weights, strict=False)) / self.kept
        base = self._mean(weights[1:])
        return (c - self.discount * seats) / (WORD_STRENGTH + self.customers) + base, base


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Words as an Arrow string column."""
    n = end - start
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    whole = data[np.repeat(start - off[:-1], n) + np.arange(off[-1])]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(whole))


def _sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, of which the JVM holds one at a time."""
    return (batch.slice(k, SENT) for k in range(0, len(batch), SENT))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of more rows, so that packets get long."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows > HELD_ASKED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        h, at, of = np.unique(np.concatenate([f[0] for f in held]), return_index=True, return_inverse=True)
        n = np.bincount(of, np.concatenate([f[1] for f in held]), minlength=len(h)).astype(np.int64)
        return h, n, pa.concat_arrays([f[2] for f in held]).take(pa.array(at))

    def passed(h: np.ndarray, n: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), words, pa.array(n)], names=["h", "word", "c"])

    size = 0
    for batch in batches:
        data, off = view(batch.column(0))
        for i, j in slices(off):
            words = Words(data, off[i : j + 1], SPACE, fold=True)
            h, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            held.append((h, n, _gather(words.bytes, words.start[at], words.end[at])))
            size += len(h)
            if size > 2 * HELD_WORDS:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_WORDS:
                    out = passed(*held[0])
                    held, size = [], 0
                    yield from _sent(out)
    if held:
        yield from _sent(passed(*merged()))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """h, c, letters and starts of vocabulary rows (h, word, c)."""
    data, off = view(batch.column(1))
    symbols, start = spelled(data, off[:-1], off[1:])
    return batch.column(0).to_numpy(), batch.column(2).to_numpy(), symbols, start


def _swept(vocabulary: DataFrame, model: Model, sweep: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Tables in all, and the keys and counts of the letters on them."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = stirling(model.discount)
        keys, counts, tables, held = [], [], 0, 0

        def merged():
            key, of = np.unique(np.concatenate(keys), return_inverse=True)
            return [key], [np.bincount(of, np.concatenate(counts), minlength=len(key))]

        for batch in batches:
            if not len(batch):
                continue
            h, c, symbols, start = _rows(batch)
            t = model.tables(sweep, h, c, symbols, start, table) if sweep else np.ones(len(c), np.int64)
            tables += int(t.sum())
            a, b = _before(symbols, start)
            keys.append((a * A + b) * A + symbols)
            counts.append(np.repeat(t, np.diff(np.append(start, len(symbols)))).astype(float))
            held += len(symbols)
            if held > HELD_LETTERS:
                keys, counts = merged()
                held = 0
        if keys:
            keys, counts = merged()
            key = np.append(keys[0], -1)
            n = np.append(counts[0], tables).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    got = vocabulary.select("h", "word", "c").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    shared.destroy()
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    return (int(n[0]), key[1:], n[1:]) if len(key) else (0, key, n)


def _contexts(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and document of each token, the ends (0) included."""
    n = len(words.n)
    place = np.arange(len(h)) + words.doc()
    a, b = np.zeros(len(h) + n, h.dtype), np.zeros(len(h) + n, h.dtype)
    b[place] = h
    a[place + 1] = h
    return a, b, np.repeat(np.arange(n), words.n + 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix2(a.view(np.uint64), b.view(np.uint64)).view(np.int64)


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether both words are frequent ones (or the end)."""
    return (a >= 0) & (a <= most) & (b >= 0) & (b <= most)


def _key(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Keys of pairs: those of frequent words (and ends) can be told apart again, others are hashes."""
    near = _near(a, b, most)
    out = np.where(near, a, 0) * (most + 1) + np.where(near, b, 0)
    far = np.flatnonzero(~near)
    out[far] = _pair(a[far], b[far])
    return out


def _xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    x = turned(x.view(np.uint64) * p2, 31) * p1 ^ (p5 + np.uint64(50))
    x = turned(x, 27) * p1 + p4
    for n, p in ((33, p2), (29, p3)):
        x ^= x >> np.uint64(n)
        x *= p
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _summed(c: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows without those whose keys are alike, with the sum of their counts in front; by the last key."""
    key = keys[-1]
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    return np.add.reduceat(c[order], first) if len(first) else c, *(x[order[first]] for x in keys)


def _paired(ranks, most: int, buckets: int, asked: bool = False):
    """Packets of the pairs of each task's texts and their counts; ranks: a broadcast.  Texts that only ask for pairs count ASKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            near = _near(a, b, most)
            c, key = _summed(np.ones(int(near.sum()), np.int64), a[near] * (most + 1) + b[near])
            yield from packed(NEAR, place(key, buckets), key, np.full(len(c), ASKED) if asked else c)
            a, b = a[~near], b[~near]
            c, a, b, key = _summed(np.ones(len(a), np.int64), a, b, _pair(a, b))
            yield from packed(FAR, place(key, buckets), a, b, np.full(len(c), ASKED) if asked else c)

        for batch in batches:
            data, off = view(batch.column(0))
            for i, j in slices(off):
                words = Words(data, off[i : j + 1], SPACE, fold=True)
                a, b, _ = _contexts(words, ranks.value.keys(words.hashes()))
                held.append((a, b))
                rows += len(a)
                if rows > HELD_TOKENS:
                    yield from merged()
                    held, rows = [], 0
        if held:
            yield from merged()

    return run


def _merged(most: int, listed):
    """(a, b, c, t) of the pairs in packets, of which listed(c) says which to keep, at one table each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole(batches):
            _, key, c = unpacked(part, NEAR, "qq")
            c, key = _summed(c, key)
            kept = listed(c)
            c, key = c[kept], key[kept]
            _, a, b, c2 = unpacked(part, FAR, "qqq")
            c2, a, b, _ = _summed(c2, a, b, _pair(a, b))
            kept = listed(c2)
            c = np.concatenate([c, c2[kept]]) % ASKED
            columns = np.concatenate([key // (most + 1), a[kept]]), np.concatenate([key % (most + 1), b[kept]]), c, np.ones(len(c), np.int64)
            yield from _sent(pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "c", "t"]))

    return run


def _renamed(words: DataFrame, ranks) -> DataFrame:
    """`words` with keys in the place of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranks.value.keys(batch.column(0).to_numpy())), *batch.columns[1:]], names=batch.schema.names)

    return words.mapInArrow(run, words.schema)


def _places(pairs: DataFrame) -> DataFrame:
    """(h, seated, saved): of each word the customers that share a table with an earlier one, in all
    contexts and in its own restaurant.  Pairs that occur once have none."""
    zero, shared = F.lit(0).cast("long"), F.col("c") - F.col("t")
    as_word = F.struct(F.col("b").alias("h"), shared.alias("seated"), zero.alias("saved"))
    as_context = F.struct(F.col("a").alias("h"), zero.alias("seated"), shared.alias("saved"))
    return pairs.where("c > t").select(F.inline(F.array(as_word, as_context))).groupBy("h").agg(F.sum("seated").alias("seated"), F.sum("saved").alias("saved"))


def _discount(n1: int | None, n2: int | None) -> float:
    n1, n2 = n1 or 0, n2 or 0
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))


def _least(df: DataFrame, column: str, most: int) -> int:
    """The smallest count that no more than so many rows reach."""
    often = df.groupBy(F.col(column).alias("c")).agg(F.count("*").alias("n")).where("c > 1").orderBy(F.desc("c")).limit(most).collect()
    least, held = (often[0].c + 1 if often else 2), 0
    for r in often:
        held += r.n
        if held > most:
            break
        least = r.c
    return least


def _fit_words(vocabulary: DataFrame, model: Model, sweeps: int) -> None:
    """So many sweeps more; before the first one each word has one table."""
    begin = len(model.states)
    for sweep in range(begin, max(begin, 1) + sweeps):
        tables, key, n = _swept(vocabulary, model, sweep)
        if model.ends:  # the end of a document is the empty word
            empty = (EDGE * A + EDGE) * A + EDGE
            t = int(model.tables(sweep, np.zeros(1, np.int64), np.array([model.end_customers]), np.array([EDGE]), np.zeros(1, np.int64), stirling(model.discount))[0]) if sweep else 1
            key, n, tables = np.append(key, empty), np.append(n, t), tables + t
            order = np.argsort(key)
            key, n = key[order], n[order]
        model.states.append((tables, fit_letters(key, n, model.states[-1][1] if model.states else None, sweep)))
    model.kept = sweeps


def _prices(vocabulary: DataFrame, model: Model) -> DataFrame:
    """(h, n, p, base, room): log10 of a word's probability and of the weight of a new table after it."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(model)

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = stirling(model.discount)
        for batch in batches:
            if len(batch):
                h, c, symbols, start = _rows(batch)
                p, base = model.priced(h, c, symbols, start, table)
                room = np.log10(batch.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *map(pa.array, (np.log10(p), base, room))], names=["h", "n", "p", "base", "room"])

    out = written(vocabulary.select("h", "word", "c", "n", "room").mapInArrow(priced, "h long, n long, p double, base double, room double"), "prices")
    shared.destroy()
    return out


def _end_price(model: Model) -> float:
    return float(np.log10(model.probability(np.zeros(1, np.int64), np.array([model.end_customers]), np.array([EDGE]), np.zeros(1, np.int64), stirling(model.discount))[0]))


def _weighed(pairs: DataFrame, prices: DataFrame, model: Model, use, schema: str, name: str) -> DataFrame:
    """use(a, b, c, t, w) of all `pairs`, written; w is the log10 of the weight of a new table in a with b.

    Pairs of frequent words are weighed where they are read.  The others are joined with what they
    lack; a side that they don't lack has a key of the pair's own, so that no key is hot.
    """
    most = model.ranks.most
    often = F.col("h").between(1, most)
    top = prices.where(often).select("h", "room", "p").toArrow()
    known, room, p = np.zeros(most + 1, bool), np.zeros(most + 1), np.zeros(most + 1)
    at = top.column("h").to_numpy()
    known[at], room[at], p[at] = True, top.column("room").to_numpy(), top.column("p").to_numpy()
    known[0], room[0], p[0] = True, float(np.log10(model.end_room)), _end_price(model) if model.ends else 0.0
    shared = prices.sparkSession.sparkContext.broadcast((known, room, p))

    def looked(batch: pa.RecordBatch) -> tuple:
        known, room, p = shared.value
        a, b, c, t = (batch.column(k).to_numpy() for k in range(4))
        i, j = (np.where((x >= 0) & (x < len(known)), x, 0) for x in (a, b))
        return a, b, c, t, room[i], p[j], (i == a) & known[i], (j == b) & known[j]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c, t, room, p, x, y = looked(batch)
            yield use(*(v[x & y] for v in (a, b, c, t, room + p)))

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c, t, room, p, x, y = looked(batch)
            rest, own = ~(x & y), _pair(a, b)
            columns = [*(pa.array(v[rest]) for v in (a, b, c, t, np.where(x, own, a), np.where(y, own, b))), pa.array(room[rest], mask=~x[rest]), pa.array(p[rest], mask=~y[rest])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "c", "t", "ka", "kb", "room", "p"])

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield use(*(batch.column(k).to_numpy() for k in range(5)))

    pairs, rare = pairs.select("a", "b", "c", "t"), prices.where(~often)
    rest = pairs.mapInArrow(lacking, "a long, b long, c long, t long, ka long, kb long, room double, p double")
    for key, value in (("ka", "room"), ("kb", "p")):
        rest = rest.join(rare.select(F.col("h").alias(key), F.col(value).alias(f"own_{value}")).hint("shuffle_hash"), key, "left")
    rest = rest.select("a", "b", "c", "t", (F.coalesce("room", "own_room") + F.coalesce("p", "own_p")).alias("w"))
    out = written(pairs.mapInArrow(whole, schema).unionByName(rest.mapInArrow(late, schema)), name)
    shared.destroy()
    return out


def _seated(pairs: DataFrame, prices: DataFrame, model: Model, sweep: int) -> DataFrame:
    """`pairs` with new tables."""
    d = model.pair_discount
    table = stirling(d)

    def use(a: np.ndarray, b: np.ndarray, c: np.ndarray, t: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        t = seat(c, np.maximum(10**w, 1e-300), d, uniform(_pair(a, b), 2000 + sweep), table)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, c, t)], names=["a", "b", "c", "t"])

    return _weighed(pairs, prices, model, use, "a long, b long, c long, t long", "seated")


def fit(train: DataFrame, text_col: str = "text", sweeps: int = SWEEPS, pair_sweeps: int = PAIR_SWEEPS, others: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """The model of the texts, and the vocabulary as a table (h, word, n, c, room): a word's
    tokens, its customers in the restaurant of words, and the weight of back-off after it.

    A null text counts as empty: its only token is the end, which is the word 0 in pairs.  Texts
    of any length are read whole; rows that are alike count each; other columns are not read; of
    an empty table the model is the unknown word alone.

    With `others`, a table that nothing is learned from, pairs that occur once are listed only if a
    text of it has them.  The model is the same, but `score` then takes rows of `others` and, marked
    as `trained`, rows of `train`; without it, any rows.
    """
    ends = train.count()
    texts = train.select(F.col(text_col).cast("string").alias("text"))
    words = written(texts.mapInArrow(_counted, "h long, word string, c long").groupBy("h", "word").agg(F.sum("c").alias("n")), "words")
    least = _least(words, "n", FREQUENT)
    top = words.where(F.col("n") >= least).select("h", "n").toArrow()
    frequent = Ranks(top.column("h").to_numpy(), top.column("n").to_numpy())
    ranks = train.sparkSession.sparkContext.broadcast(frequent)
    hashed, words = words, written(_renamed(words, ranks), "words")
    dropped(hashed)
    tidied(train.sparkSession)
    most, n = frequent.most, buckets(train.sparkSession)
    counted = texts.mapInArrow(_paired(ranks, most, n), _packets.SCHEMA)
    if others is not None:
        asking = others.select(F.col(text_col).cast("string").alias("text"))
        counted = counted.unionByName(asking.mapInArrow(_paired(ranks, most, n, asked=True), _packets.SCHEMA))
    every = others is None
    pairs = written(dealt(counted).mapInArrow(_merged(most, lambda c: (c % ASKED > 1) | (c % ASKED == 1) & (every | (c >= ASKED))), "a long, b long, c long, t long"), "pairs")
    ranks.destroy()
    tidied(train.sparkSession)
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    model = Model((total.n or 0) + ends, total.v + (ends > 0), ends, 0.5, [], ranks=frequent)
    # the tokens of pairs that don't repeat are the pairs that occur once
    some = pairs.where("c > 1").agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 2).alias("n2")).first()
    model.pair_discount = _discount(model.tokens - (some.n or 0), some.n2)
    for sweep in range(pair_sweeps + 1):
        places = written(_places(pairs), "places")
        end = places.where("h = 0").first()
        model.end_customers = ends - (end.seated if end else 0)
        model.end_room = PAIR_STRENGTH + model.pair_discount * (ends - (end.saved if end else 0))
        seated, saved = F.coalesce("seated", F.lit(0)), F.coalesce("saved", F.lit(0))
        vocabulary = written(words.join(places, "h", "left").select("h", "word", "n", (F.col("n") - seated).alias("c"), (PAIR_STRENGTH + model.pair_discount * (F.col("n") - saved)).alias("room")), "vocabulary")
        x = vocabulary.agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
        model.customers, model.discount = (x.c or 0) + model.end_customers, _discount(x.n1, x.n2)
        dropped(places)
        last = sweep == pair_sweeps
        _fit_words(vocabulary, model, sweeps if last else BURN_IN)
        if not last:
            prices = _prices(vocabulary, model)
            old, pairs = pairs, _seated(pairs, prices, model, sweep)
            for done in (prices, vocabulary, old):
                dropped(done)
            tidied(train.sparkSession)
    dropped(words)
    model.pairs = pairs
    return model, vocabulary


def _added(prices: DataFrame, model: Model) -> DataFrame:
    """(key, c, more): log10 of a seen pair's probability over what back-off alone gives it."""
    d, most = model.pair_discount, model.ranks.most

    def use(a: np.ndarray, b: np.ndarray, c: np.ndarray, t: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        more = np.log10(1 + np.maximum(c - d * t, 0) / 10**w)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (_key(a, b, most), c, more)], names=["key", "c", "more"])

    return _weighed(model.pairs, prices, model, use, "key long, c long, more double", "added")


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text", trained: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probabilities) of every row of `docs`.

    Null and empty texts have one token, the end.  Rows that are alike, and rows without an id, are
    scored each; texts of any length whole; ids must be numbers; other columns are not read.
    Rows for which `trained` is true must be rows that the model learned from: their pairs that
    aren't among those that repeat occur once, and needn't be listed in the model.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    prices = _prices(vocabulary, model)
    known = prices.agg(F.sum("base")).first()[0] or 0.0
    most = model.ranks.most
    often = F.col("h").between(1, most)
    top = prices.where(often).select("h", "n", "p", "room").toArrow()
    more_of = _added(prices, model)
    tidied(spark)
    least_pair = _least(more_of, "c", FREQUENT_PAIRS)
    top_pairs = more_of.where(F.col("c") >= least_pair).select("key", "more").toArrow().sort_by("key")
    tidied(spark)
    frequent_pairs = context.broadcast((top_pairs.column("key").to_numpy(), top_pairs.column("more").to_numpy()))
    # pairs that can't be among those listed stay where they are
    dishes = Sieve(more_of.select(F.xxhash64("key").alias("key")), "key")
    own = 1 - model.pair_discount  # what a pair that occurs once has besides back-off
    total = model.tokens + model.types + 1
    unseen = -np.log10(total)
    h, n, p, room = (top.column(k).to_numpy() for k in range(4))
    top_base, top_p, top_room, top_q = (np.zeros(most + 1) for _ in range(4))
    top_base[h], top_p[h], top_room[h] = np.log10(n + 1.0) + unseen, p, room
    # as a word and as a context, where nothing but back-off is left
    top_q[h] = p + room - np.log10(n + PAIR_STRENGTH)
    if model.ends:
        top_p[0], top_room[0] = _end_price(model), float(np.log10(model.end_room))
    frequent = context.broadcast((model.ranks, top_base, top_q, top_p, top_room))
    end_base = float(np.log10(model.ends + 1.0) + unseen)
    end_of = np.array([EDGE]), np.zeros(1, np.int64)
    if model.ends:
        known += float(model.base(*end_of)[0])
    unknown = float(np.log10(model.unknown(known)))
    end_score = _end_price(model) + float(np.log10(model.end_room / (PAIR_STRENGTH + model.ends))) if model.ends else unknown

    n_buckets = buckets(spark)
    sides = context.broadcast((top_p, top_room))
    model_ends = model.ends

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known_base, known_q, known_p, known_room = frequent.value
        pair_key, pair_more = frequent_pairs.value
        uid = TaskContext.get().partitionId() << 36
        held: dict[int, list] = {}

        def made(kind: int, *columns: np.ndarray) -> None:
            held.setdefault(kind, []).append(columns)

        def passed() -> Iterator[pa.RecordBatch]:
            for kind, columns in held.items():
                columns = [np.concatenate(x) for x in zip(*columns, strict=True)]
                # texts lie by their own number, all else by the word or pair looked up
                yield from packed(kind, place(columns[0 if kind == TEXT else 1], n_buckets), *columns)
            held.clear()

        def listed(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where the values of each document are, each once, and how often it has them; by document."""
            h = mix2(x.view(np.uint64), doc.astype(np.uint64))
            order = np.argsort(h)
            first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
            at = order[first]
            by = np.argsort(at)
            return at[by], np.diff(np.append(first, len(order)))[by]

        rows = 0
        for batch in batches:
            data, off = view(batch.column(1))
            learned = batch.column(2).to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0)
            has_id, doc_ids = ~doc_ids.is_null().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy()
            for i, j in slices(off):
                words = Words(data, off[i : j + 1], SPACE, fold=True)
                h, doc, n = ranks.keys(words.hashes()), words.doc(), j - i
                seen = (h > 0) & (h <= ranks.most)
                base, total = np.full(n, end_base), np.full(n, end_score)
                base += np.bincount(doc[seen], known_base[h[seen]], minlength=n)
                total += np.bincount(doc[seen], known_q[h[seen]], minlength=n)
                a, b, pair_doc = _contexts(words, h)
                key = _key(a, b, ranks.most)
                near_a, near_b = ((x >= 0) & (x <= ranks.most) for x in (a, b))
                # the parts of the weight of a new table in a with b that are known here
                of_a, of_b = (np.where(near, known[np.where(near, x, 0)], 0.0) for near, known, x in ((near_a, known_room, a), (near_b, known_p, b)))
                has = dishes.has(_xxhash64(key))
                may = np.flatnonzero(has)
                x, of = np.unique(key[may], return_inverse=True)
                no = np.minimum(np.searchsorted(pair_key, x), len(pair_key) - 1)
                found = pair_key[no] == x if len(pair_key) else np.zeros(len(x), bool)
                hit = found[of]
                total += np.bincount(pair_doc[may[hit]], pair_more[no[of[hit]]], minlength=n)
                # pairs that surely occur once
                single = learned[i:j][pair_doc] & ~has
                here = np.flatnonzero(single & near_a & near_b)
                total += np.bincount(pair_doc[here], np.log10(1 + own / 10 ** (of_a[here] + of_b[here])), minlength=n)
                n_known = np.bincount(doc[seen], minlength=n) + (model_ends > 0)
                made(TEXT, uid + np.arange(n), np.where(has_id[i:j], doc_ids[i:j], 0), has_id[i:j].astype(np.int64), words.n + 1, n_known, base, total)
                # rare words, with the known sides of the pairs before and after them that surely occur once
                far, before = np.flatnonzero(~seen), np.flatnonzero(~seen) + doc[~seen]
                l = np.where(single[before] & near_a[before], of_a[before], np.nan)
                r = np.where(single[before + 1] & near_b[before + 1], of_b[before + 1], np.nan)
                alone = np.isnan(l) & np.isnan(r)
                at, times = listed(h[far[alone]], doc[far[alone]])
                at = np.concatenate([np.flatnonzero(alone)[at], np.flatnonzero(~alone)])
                times = np.concatenate([times, np.ones(len(at) - len(times), np.int64)])
                made(ASK_WORD, uid + doc[far[at]], h[far[at]], times, l[at], r[at])
                # pairs to be looked up; if one of a training text isn't found, it occurs once
                at, times = listed(key[may[~hit]], pair_doc[may[~hit]])
                at = may[~hit][at]
                open_ = learned[i:j][pair_doc[at]] & (times == 1)
                split = open_ & ~(near_a[at] & near_b[at])
                alike = at[~split]
                made(ASK_PAIR, uid + pair_doc[alike], key[alike], 2 * times[~split] + open_[~split])
                at = at[split]
                made(ASK_SPLIT, uid + pair_doc[at], key[at], at, of_a[at] + of_b[at])
                # their rare sides, and those of pairs of two rare words that surely occur once
                at = np.concatenate([at, np.flatnonzero(single & ~near_a & ~near_b)])
                for side, near, x in ((0, near_a, a), (1, near_b, b)):
                    k = at[~near[at]]
                    made(ASK_SIDE, uid + pair_doc[k], x[k], 2 * k + side)
                uid += n
                rows += len(far) + len(may) - int(hit.sum())
                if rows > HELD_ASKED:
                    yield from passed()
                    rows = 0
        yield from passed()

    def known_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            key, more = (batch.column(k).to_numpy() for k in range(2))
            yield from packed(KNOWN_PAIR, place(key, n_buckets), key, more)

    def known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            h, n, p, room = (batch.column(k).to_numpy() for k in range(4))
            yield from packed(KNOWN_WORD, place(h, n_buckets), h, n, p, room)

    def once(w: np.ndarray) -> np.ndarray:
        return np.log10(1 + own / 10**w)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is looked up, in its bucket, is answered in the bucket of its text.  What is known comes first in a bucket."""
        known_p, known_room = sides.value
        columns = {KNOWN_PAIR: "qd", KNOWN_WORD: "qqdd"}
        known: dict[int, list[np.ndarray]] = {}
        of_pairs, of_words, of_splits, rows = [], [], [], 0

        def passed() -> Iterator[pa.RecordBatch]:
            for kind, held in ((OF_PAIR, of_pairs), (OF_WORD, of_words)):
                if held:
                    uid, *sums = (np.concatenate(x) for x in zip(*held, strict=True))
                    uid, of = np.unique(uid, return_inverse=True)
                    yield from packed(kind, place(uid, n_buckets), uid, *(np.bincount(of, x) for x in sums))
            if of_splits:
                uid, *rest = (np.concatenate(x) for x in zip(*of_splits, strict=True))
                yield from packed(OF_SPLIT, place(uid, n_buckets), uid, *rest)
            for held in (of_pairs, of_words, of_splits):
                held.clear()

        def find(kind: int, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            """Whether each is known, and what is known of those."""
            _, key, *rest = known[kind]
            at = np.minimum(np.searchsorted(key, x), len(key) - 1)
            if not len(key):
                return np.zeros(len(x), bool), [r[:0] for r in rest]
            found = key[at] == x
            return found, [r[at[found]] for r in rest]

        for part in _packets.parts(batches):
            first = part.column("bucket")[0].as_py()
            for kind, types in columns.items():
                new = unpacked(part, kind, types)
                if kind in known:  # the rest of a bucket
                    held = known[kind][0] == first
                    new = [np.concatenate([x[held], y]) for x, y in zip(known[kind], new, strict=True)]
                order = np.argsort(new[1])
                known[kind] = [x[order] for x in new]
            _, uid, key, times = unpacked(part, ASK_PAIR, "qqq")
            found, (more,) = find(KNOWN_PAIR, key)
            score = np.zeros(len(key))
            score[found] = more * (times[found] >> 1)
            single = np.flatnonzero(~found & (times & 1 == 1))
            score[single] = once(known_room[key[single] // (most + 1)] + known_p[key[single] % (most + 1)])
            some = score != 0
            of_pairs.append((uid[some], score[some]))
            _, uid, key, times, l, r = unpacked(part, ASK_WORD, "qqqdd")
            found, (n, p, room) = find(KNOWN_WORD, key)
            base, score = times * unseen, times * unknown
            log_n = np.log10(n + 1.0)
            base[found] = times[found] * (log_n + unseen)
            score[found] = times[found] * (p + room - log_n) + np.nan_to_num(once(l[found] + p)) + np.nan_to_num(once(room + r[found]))
            of_words.append((uid, times * found, base, score))
            _, uid, key, at, w = unpacked(part, ASK_SPLIT, "qqqd")
            found, (more,) = find(KNOWN_PAIR, key)
            value = np.full(len(key), np.nan)
            value[found] = more
            of_splits.append((uid, at, w, value))
            _, uid, key, at = unpacked(part, ASK_SIDE, "qqq")
            found, (_, p, room) = find(KNOWN_WORD, key)
            w = np.zeros(len(key))
            w[found] = np.where(at[found] & 1, p, room)
            of_splits.append((uid, at >> 1, w, np.full(len(key), np.nan)))
            rows += sum(len(x[-1][0]) for x in (of_pairs, of_words)) + len(of_splits[-1][0]) + len(of_splits[-2][0])
            # texts go on as they are
            texts = part.filter(pa.array(part.column("kind").to_numpy() == TEXT))
            if len(texts):
                yield texts
            if rows > HELD_ASKED:
                yield from passed()
                rows = 0
        yield from passed()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole(batches):
            _, text, doc_id, has_id, n_tokens, n_known, base, score = unpacked(part, TEXT, "qqqqqdd")
            order = np.argsort(text)
            text = text[order]

            def added(to: np.ndarray, uid: np.ndarray, value: np.ndarray, text: np.ndarray = text) -> np.ndarray:
                return to + np.bincount(np.searchsorted(text, uid), value, minlength=len(text))

            n_known, base, score = n_known[order], base[order], score[order]
            _, uid, value = unpacked(part, OF_PAIR, "qd")
            score = added(score, uid, value)
            _, uid, times, more_base, value = unpacked(part, OF_WORD, "qddd")
            n_known, base, score = added(n_known, uid, times), added(base, uid, more_base), added(score, uid, value)
            _, uid, at, w, more = unpacked(part, OF_SPLIT, "qqdd")
            by = np.lexsort((at, uid))
            uid, at, w, more = uid[by], at[by], w[by], more[by]
            first = np.flatnonzero((np.diff(uid, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
            if len(first):
                w, more = np.add.reduceat(w, first), np.fmax.reduceat(more, first)
                score = added(score, uid[first], np.where(np.isnan(more), once(w), more))
            ids = pa.array(doc_id[order], mask=has_id[order] == 0)
            out = [ids, pa.array(n_tokens[order]), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score)]
            yield from _sent(pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "n_known", "base_score", "score"]))

    # What is known only of rare words and pairs, and what texts ask of them, meets in buckets; the answers
    # meet the texts in buckets of their own.  A pair that may occur once and has rare words asks for itself and
    # for what each of these words adds to the weight; other pairs' frequent words are known where they are answered.
    # A text's number comes from the task that also makes what it asks, so a task run again stays in step.
    trained = F.lit(False) if trained is None else F.coalesce(trained, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), trained.alias("trained"))
    rare = prices.where(~often).select("h", "n", "p", "room").mapInArrow(known_words, _packets.SCHEMA)
    pairs = more_of.where(F.col("c") < least_pair).select("key", "more").mapInArrow(known_pairs, _packets.SCHEMA)
    asked = docs.mapInArrow(read, _packets.SCHEMA).unionByName(rare).unionByName(pairs)
    answers = dealt(asked).mapInArrow(answered, _packets.SCHEMA)
    return dealt(answers).mapInArrow(summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds the perplexity per token to the result of `score`."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
