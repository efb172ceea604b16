"""Best-fit packing of tokenized documents, planned on the histogram of their lengths.

Documents are tokenized once, into pieces of at most `capacity` tokens.  The plan is made over
counts: at most `capacity` lengths, each with its number of pieces, are placed by best-fit
decreasing, whole classes of equally filled sequences at a time, so that planning costs the
same for a thousand pieces and for a trillion.  A plan is a list of runs of slots.  Pieces take
the slots by joining on their rank within their length.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm._shared import written

CAPACITY, END_ID, BUCKETS = 1024, 2, 256

#: Fixed: how the byte-level tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(path: str):
    """A function from a text to its ids, without special tokens added.

    For a byte-level BPE file the ids come from tiktoken, loaded with that file's vocabulary,
    which merges the same way several times faster; texts that hold an added token's string,
    and files of other kinds, go through tokenizers.
    """

    @functools.cache
    def plain():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return plain().encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    plain_bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("ignore_merges", "dropout", "byte_fallback", "fuse_unk", "continuing_subword_prefix", "end_of_word_suffix"))
    split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain_bpe or not split or spec.get("normalizer") or not _in_rank_order(model):
        return slow
    import tiktoken

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        return slow(text) if any(a in text for a in added) else fast(text)

    return encode


def _in_rank_order(model: dict) -> bool:
    """Whether merges come in the order of the ids that they make, which is the order tiktoken merges in."""
    ids = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return all(a < b for a, b in zip(ids, ids[1:], strict=False)) and -1 not in ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], PIECE.replace(" long", "").replace(" int", "").split(", "))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces per sequence, offset).

    Best-fit decreasing: longest pieces first, each into the fullest sequence that still takes
    it.  Sequences with equal room are handled together, as (first id, how many) intervals.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    out, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(order, left)
            room[left].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        n, rank = counts[length], 0
        while rank < n:
            k = bisect_left(order, length)
            if k < len(order):
                left = order[k]
                first, have = room[left].pop()
                if not room[left]:
                    del room[left], order[k]
            else:
                left, first, have = capacity, opened, -(-(n - rank) // (capacity // length))
                opened += have
            each = min(left // length, n - rank)
            used = min(have, (n - rank) // each)
            out.append((length, rank, rank + used * each, first, each, capacity - left))
            rank += used * each
            put(left - each * length, first, used)
            put(left, first + used, have - used)
    return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """Place every document, tokenized and ended by `end_id`, in sequences of `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the one token `end_id`.  A document longer than a sequence is cut
    into full pieces, of which only the first may be shorter.  Rows with the same id and text
    each get their own place, ties of rank being broken by the piece's content and then at
    will, and an empty table gives none.  A row without an id is packed too, with a null id; ids
    must be numbers; texts of any length are tokenized whole; other columns are not read.  The
    tokenizer's file must be there on every executor under the same path.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, capacity, tokenizer or default_tokenizer(), end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), "length long, a long, b long, seq long, each long, at long")
    # ranks within a length are dealt by (length, bucket), as one length may hold most pieces
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("local", local).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("local")).drop("bucket", "base", "local")
    inside = (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["a"]) & (ranked["rank"] < runs["b"])
    nth = F.col("rank") - F.col("a")
    # the plan has a bounded number of runs, whatever the table: see test_plan_is_bounded
    return ranked.join(F.broadcast(runs), inside).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("seq") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * ranked["length"]).cast("long").alias("offset"),
    )
