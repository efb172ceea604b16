"""Landed batches as a stream that is merged into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.plans.jobs import merge_records
from foliant.schemas import LANDING
from foliant.sources.tables import Store


def ingest(store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge citation batches as they are landed.

    The checkpoint says which files have been merged, and a merge may be repeated without harm, so
    a query that is stopped anywhere goes on where it was.
    """
    rows = store.spark.readStream.schema(LANDING).option("recursiveFileLookup", "false").parquet(f"{store.root}/landing")

    def merge(batch: DataFrame, _: int) -> None:
        merge_records(store, batch)

    writer = rows.where(F.col("kind") == "pubmed").writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer).start()


def without_repeats(stream: DataFrame, key: str = "pmid", at: str = "landed_at", overlap: str = "3 days") -> DataFrame:
    """Rows of a stream that is read again over an overlap, each key once in it."""
    return stream.withWatermark(at, overlap).dropDuplicatesWithinWatermark([key])
