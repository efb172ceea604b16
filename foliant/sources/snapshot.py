"""Snapshots: a corpus as one JSON object a line, ordered by record number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import strip
from foliant.operators.corpus import with_paper
from foliant.schemas import FULLTEXT, PUBMED, fields

#: Names at the top of a record of an older format.
LEGACY = ("raw_xml", "abstract_text", "fulltext_status", "authors")

_DATES = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DateType) else f.dataType) for f in PUBMED])
_PAPER = T.StructType([*fields("pmid string, jats_xml string"), T.StructField("fulltext_jats", FULLTEXT), T.StructField("citation", T.StringType())])
LINE = T.StructType(
    [
        *fields("pmid string, pubmed_xml string"), T.StructField("pubmed_json", _DATES),
        *fields("entry_date string, pub_year int, pmc_id string, is_retracted boolean, fetch_failed boolean"), T.StructField("paper", _PAPER),
    ]
)


class LegacyShape(ValueError):
    pass


def _record() -> list[Column]:
    p = F.col("pubmed")
    payload = F.struct(*(F.date_format(p[f.name], "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType) else p[f.name].alias(f.name) for f in PUBMED))
    return ["pmid", "pubmed_xml", F.when(p.isNotNull(), payload).alias("pubmed_json"), F.date_format("entry_date", "yyyy-MM-dd").alias("entry_date"), "pub_year", "pmc_id", "is_retracted", "fetch_failed"]


def encode(abstract: DataFrame, paper: DataFrame) -> DataFrame:
    """(pmid, value): NULLs are written, but a record without a paper has no such field."""
    both = with_paper(abstract, paper)
    held = F.struct(F.col("paper.pmid").alias("pmid"), F.col("paper.jats_xml").alias("jats_xml"), F.col("paper.fulltext").alias("fulltext_jats"), F.col("paper.citation").alias("citation"))
    options = {"ignoreNullFields": "false"}
    line = F.when(F.col("paper").isNull(), F.to_json(F.struct(*_record()), options)).otherwise(F.to_json(F.struct(*_record(), held.alias("paper")), options))
    return both.select("pmid", line.alias("value"))


def export(abstract: DataFrame, paper: DataFrame, path: str) -> int:
    """Write a snapshot, ordered over all its part files; the number of records."""
    lines = encode(abstract, paper).orderBy("pmid")
    lines.select("value").write.mode("overwrite").text(path)
    return abstract.sparkSession.read.text(path).count()


def decode(lines: DataFrame) -> DataFrame:
    """Parsed lines (column value): the columns of abstract, and paper as a struct or NULL.

    Blank lines count for nothing.  A line in an older shape, or that is no JSON object with a
    record number, fails the whole import before anything is written.
    """
    lines = lines.where(strip(F.col("value")) != "")
    old = [F.col("value").isNotNull() & F.array_contains(F.json_object_keys("value"), k) for k in LEGACY]
    legacy = old[0] | old[1] | old[2] | old[3]
    r = F.from_json("value", LINE)
    checked = F.when(legacy, F.raise_error(F.lit("LEGACY_SHAPE: a record of an older snapshot format"))).when(r["pmid"].isNull(), F.raise_error(F.concat(F.lit("BAD_LINE: "), F.substring("value", 1, 200)))).otherwise(r)
    parsed = lines.select(checked.alias("r"))
    p = F.col("r.pubmed_json")
    payload = F.struct(*(p[f.name].cast(f.dataType).alias(f.name) for f in PUBMED))
    paper = F.struct(F.col("r.paper.pmid").alias("pmid"), F.col("r.paper.jats_xml").alias("jats_xml"), F.col("r.paper.fulltext_jats").alias("fulltext"), F.col("r.paper.citation").alias("citation"))
    return parsed.select(
        F.col("r.pmid").alias("pmid"), F.col("r.pubmed_xml").alias("pubmed_xml"), F.when(p.isNotNull(), payload).alias("pubmed"), F.col("r.entry_date").cast("date").alias("entry_date"),
        F.col("r.pub_year").alias("pub_year"), F.col("r.pmc_id").alias("pmc_id"), F.coalesce("r.is_retracted", F.lit(False)).alias("is_retracted"),
        F.coalesce("r.fetch_failed", F.lit(False)).alias("fetch_failed"), F.when(F.col("r.paper").isNotNull(), paper).alias("paper"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.text(path))
