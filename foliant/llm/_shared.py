"""Places shared by all executors, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_fallback: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set as the checkpoint folder; in local mode (tests), where
    neither is, a temporary one.  On a cluster that would be another folder on each machine."""
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return _fallback[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again.

    Unlike a cached frame the copy outlives the executors that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame made by `written`, once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/foliant-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are done with.

    It does so when the driver's JVM collects its garbage, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # texts of any length go to Python in batches: fewer rows each keep an executor's memory low
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(spark: SparkSession) -> None:
    """Delete the tables that this process wrote to the shared folder.

    A frame that an operator returned may still read some: call this when results are stored.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


class Sieve:
    """A set of long ids as a bit map of bounded size (16 MB at most), to leave most other rows
    where they are before a join.  It never loses a member; with many ids it lets more others pass.
    """

    MOST_BITS = 1 << 27

    def __init__(self, ids: DataFrame, column: str = "doc_id"):
        spark = ids.sparkSession
        ids = ids.select(F.col(column).cast("long").alias("id"))
        n = ids.count()
        bits = 1 << 16
        while bits < min(16 * n, self.MOST_BITS):
            bits <<= 1
        place = F.expr(f"((id ^ shiftright(id, 27)) & {bits - 1}L) + 1")  # bit maps count from 1
        pieces = ids.dropna().select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b")).collect()
        whole = np.zeros(bits // 8 + 4096, np.uint8)
        for r in pieces:
            whole[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.b), np.uint8)
        self.bits, self.map = bits, spark.sparkContext.broadcast(whole)

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Whether each id may be a member."""
        # position p is bit p % 8 of byte p // 8, buckets of 32768 bits one after the other
        p = (ids ^ (ids >> 27)) & (self.bits - 1)
        return (self.map.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    def split(self, df: DataFrame, column: str, member: bool) -> DataFrame:
        """The rows that may be members, or those that surely aren't; a null id is taken for a member."""
        k = df.columns.index(column)

        def run(batches):
            for batch in batches:
                ids = batch.column(k)
                found = self.has(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
                found |= ids.is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found == member))

        return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))
