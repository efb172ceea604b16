"""Versioned Parquet tables with a log of commits.

A commit writes new versions of one or several tables, each to a folder of its own, and then one
small file in the log that names the version of every table.  The highest whole entry of the log
is the store's state: readers see all tables before a commit or all after it, and a writer that
dies anywhere leaves the state as it was.  Nothing is deleted before the entry that replaces it
is there.  Two writers can't make the same entry, so of two at once one fails.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import schemas

TABLES = {"abstract": schemas.ABSTRACT, "paper": schemas.PAPER, "corpus_config": schemas.CORPUS_CONFIG}
#: The tables of each version of the schema, each with those before it.
SCHEMAS = ((), ("abstract", "paper"), ("abstract", "paper", "corpus_config"))
SCHEMA_VERSION = len(SCHEMAS) - 1


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entries(self) -> list[int]:
        """The numbers in the log, the last first."""
        path = self._path("_log")
        fs = self._fs(path)
        if not fs.exists(path):
            return []
        return sorted((int(n) for s in fs.listStatus(path) if (n := s.getPath().getName()).isdigit()), reverse=True)

    def _entry(self, n: int) -> dict | None:
        """A log entry; None if its writer died over it."""
        path = self._path("_log", f"{n:012d}")
        stream = self._fs(path).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "null")
        except ValueError:
            return None
        finally:
            stream.close()

    def state(self) -> dict:
        """{"schema": version, "tables": {name: version}} after the last whole commit."""
        return next((e for n in self._entries() if (e := self._entry(n))), {"schema": 0, "tables": {}})

    def version(self, name: str) -> int | None:
        return self.state()["tables"].get(name)

    def read(self, name: str) -> DataFrame:
        """The current version, or an empty table."""
        v = self.version(name)
        if v is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v={v}")

    def commit(self, tables: dict[str, DataFrame], schema: int | None = None, without: tuple[str, ...] = ()) -> int:
        """New versions of these tables, all at once; the number of the commit."""
        before, n = self.state(), max(self._entries(), default=0) + 1
        for name, df in tables.items():
            rows = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in TABLES[name]))
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v={n}")
        after = {k: v for k, v in before["tables"].items() if k not in without} | dict.fromkeys(tables, n)
        known = max((k for k, names in enumerate(SCHEMAS) if set(names) <= set(after)), default=0)
        self._log(n, {"schema": known if schema is None else schema, "tables": after})
        self._tidy()
        return n

    def _log(self, n: int, entry: dict) -> None:
        path = self._path("_log", f"{n:012d}")
        out = self._fs(path).create(path, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def _tidy(self) -> None:
        """Delete versions that none of the last `keep` states has."""
        states = [e for n in self._entries() if (e := self._entry(n))][: self.keep]
        for name in TABLES:
            path = self._path(name)
            fs = self._fs(path)
            held = {s["tables"].get(name) for s in states}
            for s in fs.listStatus(path) if fs.exists(path) else ():
                folder = s.getPath().getName()
                if folder.startswith("v=") and int(folder[2:]) not in held and int(folder[2:]) < max((v for v in held if v), default=0):
                    fs.delete(s.getPath(), True)
        for n in self._entries()[4 * self.keep :]:
            path = self._path("_log", f"{n:012d}")
            self._fs(path).delete(path, False)

    def write(self, name: str, df: DataFrame) -> int:
        """A new version of one table."""
        return self.commit({name: df})

    def create(self) -> None:
        """Tables that aren't there yet, empty."""
        self.migrate(SCHEMA_VERSION)

    def migrate(self, schema: int) -> None:
        """Bring the store to a version of the schema: up by adding empty tables, down by taking tables away."""
        if not 0 <= schema <= SCHEMA_VERSION:
            raise ValueError(f"schema {schema} isn't known; there are 0 to {SCHEMA_VERSION}")
        wanted, state = SCHEMAS[schema], self.state()
        new = {name: self.spark.createDataFrame([], TABLES[name]) for name in wanted if name not in state["tables"]}
        old = tuple(name for name in state["tables"] if name not in wanted)
        if new or old or state["schema"] != schema:
            self.commit(new, schema, old)

    def drop(self) -> None:
        for name in ("_log", *TABLES):  # the log first: without it nothing is there
            path = self._path(name)
            self._fs(path).delete(path, True)

    # landed responses

    def land(self, rows: DataFrame) -> None:
        """Append responses under their run, the batch's name without its number; each call is durable by itself."""
        run = F.regexp_extract("batch_id", r"^(.*)-\d+$", 1)
        rows.select(*schemas.LANDING.fieldNames(), F.when(run != "", run).otherwise(F.col("batch_id")).alias("run")).write.mode("append").partitionBy("run", "kind").parquet(f"{self.root}/landing")

    def landed(self, run: str | None = None) -> DataFrame:
        """What was landed; of one run, if asked for, with no other folder read."""
        base = f"{self.root}/landing"
        at = f"{base}/run={run}" if run else base
        path = self._path("landing", *([f"run={run}"] if run else []))
        if not self._fs(path).exists(path):
            return self.spark.createDataFrame([], schemas.LANDING)
        return self.spark.read.schema(T.StructType([*schemas.LANDING])).option("basePath", base).parquet(at).select(*schemas.LANDING.fieldNames())
