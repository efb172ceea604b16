"""Many short rows sent through a shuffle as few long ones.

Rows of a bucket go together in one binary value, a packet: the lowest bytes of their first column, then
the next higher ones, and so on.  Bytes that are zero in all rows packed at once are left out and others
that hardly vary lie together, so the shuffle's compression finds them.  The JVM handles packets only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._text import mix

SCHEMA = "bucket int, kind int, planes long, rows binary"
NAMES = ["bucket", "kind", "planes", "rows"]
#: Bytes of packets that are unpacked at once.
LIMIT = 1 << 22
#: Packets that go to the JVM at once.
SENT = 1 << 9


def buckets(spark: SparkSession) -> int:
    """Some 16 for each shuffle partition, a power of 2; few enough that packets don't get short."""
    n = 1 << 10
    while n < min(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 14):
        n <<= 1
    return n


def place(key: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key, of n (a power of 2, at most 65536)."""
    return (mix(key.astype(np.uint64)) >> np.uint64(65 - n.bit_length())).astype(np.uint16)


def packed(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packets of rows with up to seven columns of longs or doubles; rows of a bucket keep their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + 1))
    n = np.diff(np.append(first, len(bucket)))
    used, planes = [], 0
    for k, column in enumerate(columns):
        raw = np.ascontiguousarray(column)[order].view(np.uint8).reshape(-1, 8)
        some = np.bitwise_or.reduce(column.view(np.uint64))
        for p in range(8):
            if int(some) >> 8 * p & 255:
                planes |= 1 << 8 * k + p
                used.append(raw[:, p])
    if not used:  # the length of a packet says how many rows it has
        planes, used = 1, [np.zeros(len(bucket), np.uint8)]
    at, step = np.arange(len(bucket)) + np.repeat(first * (len(used) - 1), n), np.repeat(n, n)
    whole = np.empty(len(bucket) * len(used), np.uint8)
    for plane in used:
        whole[at] = plane
        at += step
    off = (np.append(first, len(bucket)) * len(used)).astype(np.int64)
    # parts small enough for Arrow's offsets of 32 bits
    i = 0
    while i < len(n):
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + (1 << 30), "right")) - 1), i + SENT)
        rows = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((off[i : j + 1] - off[i]).astype(np.int32)), pa.py_buffer(whole[off[i] : off[j]])])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first[i:j]].astype(np.int32)), pa.array(np.full(j - i, kind, np.int32)), pa.array(np.full(j - i, planes)), rows], names=NAMES)
        i = j


def unpacked(batch: pa.RecordBatch | pa.Table, kind: int, columns: str) -> list[np.ndarray]:
    """The bucket and the columns of all rows of a kind; columns: q for longs, d for doubles."""
    found = []
    mine = batch.filter(pa.array(_numbers(batch, "kind") == kind))
    masks = _numbers(mine, "planes")
    for mask in np.unique(masks):
        part = mine.filter(pa.array(masks == mask))
        rows = part.column("rows")
        if isinstance(rows, pa.ChunkedArray):
            rows = rows.combine_chunks()
        _, off, data = rows.buffers()
        off = np.frombuffer(off, np.int64 if pa.types.is_large_binary(rows.type) else np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
        used = [p for p in range(8 * len(columns)) if int(mask) >> p & 1]
        n = np.diff(off) // len(used)
        step = np.repeat(n, n)
        at = np.arange(len(step)) + np.repeat(off[:-1] - np.cumsum(n) + n, n)
        data = np.frombuffer(data, np.uint8)
        out = np.zeros((len(columns), len(step), 8), np.uint8)
        for p in used:
            out[p // 8, :, p % 8] = data[at]
            at += step
        found.append([np.repeat(_numbers(part, "bucket"), n), *(x.reshape(-1).view(np.int64 if t == "q" else np.float64) for x, t in zip(out, columns, strict=True))])
    if not found:
        return [np.zeros(0, np.int32), *(np.zeros(0, np.int64 if t == "q" else np.float64) for t in columns)]
    return found[0] if len(found) == 1 else [np.concatenate(x) for x in zip(*found, strict=True)]


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy()


def dealt(packets: DataFrame) -> DataFrame:
    """Packets of a bucket in one task, one after the other, by kind."""
    return packets.select(*NAMES).repartition(F.col("bucket")).sortWithinPartitions("bucket", "kind")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packets of a task, a limited number of bytes at a time."""
    for batch in batches:
        step = max(1, len(batch) * LIMIT // max(1, batch.nbytes))
        yield from (batch.slice(k, step) for k in range(0, len(batch), step))


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The packets of a task, some whole buckets at a time."""
    held, size = [], 0
    for part in parts(batches):
        if size > LIMIT:
            cut = int(np.searchsorted(_numbers(part, "bucket"), held[-1].column("bucket")[-1].as_py(), "right"))
            if cut < len(part):
                yield pa.Table.from_batches([*held, part.slice(0, cut)])
                held, size, part = [], 0, part.slice(cut)
        held.append(part)
        size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)
