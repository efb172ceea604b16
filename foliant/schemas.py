"""Schemas of the corpus tables and of the nested payloads in them."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "binary": T.BinaryType(),
}


def fields(text: str) -> T.StructType:
    """A struct of plain fields; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in text.split(","))])


AUTHOR = fields(
    "position int, is_last boolean, last_name string, fore_name string, initials string, collective_name string, affiliation string, orcid string, canonical_key string"
)
AUTHORS = T.ArrayType(AUTHOR)
STRINGS = T.ArrayType(T.StringType())

#: One citation record; dates are dates here and become text only in snapshots.
PUBMED = T.StructType(
    [
        *fields(
            "pmid string, title string, journal string, volume string, issue string, pages string, doi string, pmc_id string, pub_date date, pub_year int, "
            "pub_date_raw string, entry_date date, abstract_text string, other_abstract_text string"
        ),
        T.StructField("publication_types", STRINGS),
        T.StructField("mesh_terms", STRINGS),
        T.StructField("is_retracted", T.BooleanType()),
        T.StructField("authors", AUTHORS),
    ]
)

SECTION = fields("type string, title string, text string")
FULLTEXT = T.StructType([*fields("pmcid string, license string, title string, abstract string"), T.StructField("sections", T.ArrayType(SECTION))])

#: Every known record, with or without full text.
ABSTRACT = T.StructType(
    [
        T.StructField("pmid", T.StringType()),
        T.StructField("pubmed_xml", T.StringType()),
        T.StructField("pubmed", PUBMED),
        *fields("entry_date date, pub_year int, pmc_id string, is_retracted boolean, fetch_failed boolean, ingested_at timestamp, updated_at timestamp"),
    ]
)

#: Records whose full text is held; that a row exists is the filter.
PAPER = T.StructType([*fields("pmid string, jats_xml string"), T.StructField("fulltext", FULLTEXT), T.StructField("citation", T.StringType())])

CORPUS_CONFIG = fields(
    "config_hash string, query string, year_min int, year_max int, max_records int, batch_size int, pmc_batch_size int, email string, tool string, rate_limit double, created_at timestamp"
)

#: Raw responses, as they came.
LANDING = fields("batch_id string, seq int, kind string, payload binary, landed_at timestamp")

#: Which job may change which columns of an existing row.
OWNERS = {
    "sync": ["pubmed_xml", "pubmed", "entry_date", "pub_year", "pmc_id", "is_retracted"],
    "reparse": ["pubmed", "entry_date", "pub_year", "pmc_id", "is_retracted"],
    "snapshot": ["pubmed_xml", "pubmed", "entry_date", "pub_year", "pmc_id", "is_retracted", "fetch_failed"],
    "fetch": ["jats_xml", "fulltext", "citation"],
    "citation": ["citation"],
}
