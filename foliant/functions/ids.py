"""Identifiers of records and people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import blank_to_null, flat, strip

# Public addresses of records.
RECORD_URL = "https://pubmed.ncbi.nlm.nih.gov/"
DOI_URL = "https://doi.org/"


def orcid(x: Column) -> Column:
    """Four groups of four, from a bare or hyphenated number or a URL; NULL if there is none."""
    found = F.upper(F.regexp_extract(F.replace(x, F.lit(" "), F.lit("")), r"(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])", 1))
    bare = F.upper(F.regexp_replace(x, r"[^0-9Xx]", ""))
    grouped = F.regexp_replace(bare, r"^(.{4})(.{4})(.{4})(.{4})$", "$1-$2-$3-$4")
    return F.when(found != "", found).when(F.length(bare) == 16, grouped)


def canonical_key(last: Column, fore: Column, initials: Column) -> Column:
    """Last name and first initial in lower case, to group by; NULL without a last name."""
    given = F.when(F.coalesce(fore, F.lit("")) != "", fore).otherwise(F.coalesce(initials, F.lit("")))
    return F.when(F.coalesce(last, F.lit("")) != "", F.concat(F.lower(strip(last)), F.lit("|"), F.lower(F.substring(strip(given), 1, 1))))


def pmc_prefixed(x: Column) -> Column:
    return F.when(F.upper(x).startswith("PMC"), x).otherwise(F.concat(F.lit("PMC"), x))


def pmc_bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^(?i)PMC", "")


def record_url(pmid: Column) -> Column:
    return F.concat(F.lit(RECORD_URL), pmid, F.lit("/"))


def reference_url(pmid: Column, doi: Column) -> Column:
    """The record's page, else the DOI's, else NULL."""
    return F.coalesce(record_url(blank_to_null(pmid)), F.concat(F.lit(DOI_URL), flat(doi)))


def is_retracted(publication_types: Column) -> Column:
    """Whether a type says that the article itself, and not a notice about one, is retracted."""
    return F.coalesce(F.exists(publication_types, lambda t: F.lower(strip(t)) == "retracted publication"), F.lit(False))
