"""Bibliographic references, rendered in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import SPACE, ensure_period, flat, strip

MOST_AUTHORS = 6


def author_name(a: Column) -> Column:
    """A collective's name, else last name and initials; NULL without either."""
    words = F.filter(F.split(strip(a["fore_name"]), rf"{SPACE}+"), lambda w: w != "")
    made = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    initials = F.regexp_replace(F.coalesce(flat(a["initials"]), made, F.lit("")), r"[. ]", "")
    named = F.when(flat(a["last_name"]).isNotNull(), F.concat_ws(" ", flat(a["last_name"]), F.nullif(initials, F.lit(""))))
    return F.coalesce(flat(a["collective_name"]), named)


def authors(people: Column, most: int = MOST_AUTHORS) -> Column:
    """Names in order of position, the first `most` of them; NULL if there are none."""
    placed = F.transform(F.coalesce(people, F.array()), lambda a, k: F.struct(F.coalesce(a["position"], F.lit(0)).alias("p"), k.alias("k"), author_name(a).alias("name")))
    names = F.filter(F.transform(F.array_sort(placed), lambda x: x["name"]), lambda n: n.isNotNull())
    text = F.array_join(F.slice(names, 1, most), ", ")
    return F.nullif(F.when(F.size(names) > most, F.concat(text, F.lit(", et al"))).otherwise(text), F.lit(""))


def locator(year: Column, volume: Column, issue: Column, pages: Column) -> Column:
    """Year;Volume(Issue):Pages, without what is absent; NULL if all is."""
    year = F.when(year != 0, year.cast("string"))
    volume, issue, pages = flat(volume), flat(issue), flat(pages)
    before = F.when(year.isNotNull(), ";").otherwise("")
    parts = [year, F.concat(before, volume), F.concat(F.lit("("), issue, F.lit(")"))]
    parts.append(F.concat(F.when(volume.isNotNull() | issue.isNotNull(), ":").otherwise(before), pages))
    return F.nullif(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), F.lit(""))


def identifier(pmid: Column, doi: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), flat(doi)), F.concat(F.lit("PMID: "), flat(pmid)), F.lit(""))


def reference(r: Column) -> Column:
    """Authors. Title. Journal. Locator. Identifier, of a record struct."""
    journal = F.nullif(F.regexp_replace(strip(r["journal"]), r"\.+\z", ""), F.lit(""))
    place = locator(r["pub_year"], r["volume"], r["issue"], r["pages"])
    return F.concat_ws(
        " ",
        ensure_period(authors(r["authors"])), ensure_period(r["title"]), F.concat(journal, F.lit(".")),
        F.concat(place, F.lit(".")), F.nullif(identifier(r["pmid"], r["doi"]), F.lit("")),
    )
