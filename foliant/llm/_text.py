"""Vectorised words, word hashes and n-gram hashes over Arrow string columns.

Everything works on the UTF-8 bytes of a slice of documents at once, so the cost of a word is
a few array operations and not a Python object.  Slices are cut between documents, never
inside one: a document is always seen whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    x = a ^ (a >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x += b * U(0xA0761D6478BD642F)
    x ^= x >> U(29)
    x *= U(0xE7037ED1A0B428DB)
    x ^= x >> U(32)
    return x


_BYTE = _splitmix(256, 7)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def byte_class(pattern: str) -> np.ndarray:
    """Truth per byte value; `pattern` is "space" for [^\\x20\\x09-\\x0D] or "alnum" for
    [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] (digits, a-z and whatever isn't ASCII)."""
    out = np.ones(256, bool)
    if pattern == "space":
        out[[0x20, *range(0x09, 0x0E)]] = False
    else:
        out[:0x80] = False
        out[0x30:0x3A] = True
        out[0x61:0x7B] = True
    return out


SPACE, ALNUM = byte_class("space"), byte_class("alnum")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if not len(column) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[: off[-1]], off


def slices(off: np.ndarray, limit: int = SLICE_BYTES, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of at most `most` documents of about `limit` bytes, at least one document each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n, i + most)
        yield i, j
        i = j


class Words:
    """The words of some documents: byte places `start`, `end`, and `first`, by which the words
    of document d are first[d] to first[d + 1]."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACE, fold: bool = False):
        base = int(off[0])
        self.bytes = data[base : int(off[-1])]
        if fold:
            self.bytes = FOLD[self.bytes]
        self.off = off = off - base
        n = len(self.bytes)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind[self.bytes]
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        begins[off] |= inside[off + 1]
        ends[off] |= inside[off]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)
        self.n = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from there on."""
        return np.repeat(self.first[1:], self.n) - np.arange(len(self.start))

    def hashes(self, length: int = 0) -> np.ndarray:
        """64-bit hash of each word, or of its first `length` bytes."""
        return span_hashes(self.bytes, self.start, self.end if not length else np.minimum(self.end, self.start + length))

    def text(self, k: int) -> str:
        return self.bytes[self.start[k] : self.end[k]].tobytes().decode()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from each start to its end; starts and ends must both ascend."""
    out, i, n = np.empty(len(start), U), 0, len(start)
    while i < n:
        s = start[i]
        j = max(i + 1, int(np.searchsorted(end, s + SLICE_BYTES, "right")))
        size = int(end[j - 1] - s)
        power, inverse = _tables(max(size, SLICE_BYTES) + 1)
        total = np.zeros(size + 1, U)
        np.cumsum(_BYTE[data[s : s + size]] * power[:size], out=total[1:])
        a, b = start[i:j] - s, end[i:j] - s
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(U))
        i = j
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n values of h, over document ends too (mask those by Words.left)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out, cur, size, at, k = None, h, 1, 0, n
    while True:
        if k & 1:
            part = cur[at : at + m]
            out = part if out is None else mix2(out, part)
            at += size
        k >>= 1
        if not k:
            return out
        cur = mix2(cur[:-size], cur[size:])
        size *= 2


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
