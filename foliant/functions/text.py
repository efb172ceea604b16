"""Text in columns, with Unicode white space as Python has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for Java's regular expressions that matches Python's str.strip and \s.
SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+\z", "")


def blank_to_null(x: Column) -> Column:
    """NULL where nothing but white space is left, else the value as it is."""
    return F.when(~x.rlike(rf"^{SPACE}*\z"), x)


def flat(x: Column) -> Column:
    """Stripped, inner white space kept; NULL if empty.  The form of citation records."""
    return F.nullif(strip(x), F.lit(""))


def collapsed(x: Column) -> Column:
    """Each run of white space as one space, stripped; NULL if empty.  The form of articles."""
    return F.nullif(strip(F.regexp_replace(x, rf"{SPACE}+", " ")), F.lit(""))


def ensure_period(x: Column) -> Column:
    """Stripped, and ended by a period unless it ends a sentence already; NULL if empty."""
    s = flat(x)
    return F.when(s.rlike(r"[.?!]\z"), s).otherwise(F.concat(s, F.lit(".")))


def joined(parts: Column, separator: str) -> Column:
    """The texts of an array in order, without empty ones; NULL if there are none."""
    return F.nullif(F.array_join(F.filter(parts, lambda t: F.coalesce(t, F.lit("")) != ""), separator), F.lit(""))


def iso(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")
