"""Operators over the tables abstract, paper and corpus_config."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.citation import reference
from foliant.functions.ids import pmc_bare
from foliant.functions.sections import effective_type, has_body
from foliant.functions.text import blank_to_null

#: Ids sent to the executors as literals; longer lists are joined.
MOST_LITERALS = 1000


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last in this order, as if rows had been written one by one; without an
    order any of them."""
    place = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order or [key]))
    return df.withColumn("_nth", F.row_number().over(place)).where("_nth = 1").drop("_nth")


def merge_upsert(
    target: DataFrame, source: DataFrame, key: str, update: list[str], defaults: dict[str, Column] | None = None, touch: str | None = "updated_at",
) -> DataFrame:
    """`target` with the rows of `source` (one per key) put in.

    Of a row that exists only the columns in `update` change, and `touch`; a new row gets those,
    and `defaults` or NULL for the others.
    """
    defaults = defaults or {}
    s = source.select(F.col(key).alias("_key"), F.lit(True).alias("_given"), *(F.col(c).alias(f"_{c}") for c in update))
    both = target.withColumn("_known", F.lit(True)).join(s, F.col(key) == F.col("_key"), "full")
    out = []
    for f in target.schema:
        old, new = F.col(f.name), defaults.get(f.name, F.lit(None))
        if f.name == key:
            value = F.coalesce(old, F.col("_key"))
        elif f.name in update:
            value = F.when(F.col("_given"), F.col(f"_{f.name}")).otherwise(old)
        elif f.name == touch:
            value = F.when(F.col("_given"), F.current_timestamp()).otherwise(old)
        else:
            value = F.when(F.col("_known"), old).otherwise(new)
        out.append(value.cast(f.dataType).alias(f.name))
    return both.select(*out)


def insert_if_absent(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """`target` and the rows of `source` whose key it doesn't have."""
    return target.unionByName(source.join(target, key, "left_anti"))


def abstract_values(records: DataFrame) -> DataFrame:
    """What a sync stores of parsed records (pubmed_xml, pubmed), with their place if there is one."""
    p = F.col("pubmed")
    place = [c for c in ("batch_id", "seq") if c in records.columns]
    return records.select(
        *place, p["pmid"].alias("pmid"), "pubmed_xml", "pubmed", p["entry_date"].alias("entry_date"), p["pub_year"].alias("pub_year"),
        blank_to_null(p["pmc_id"]).alias("pmc_id"), p["is_retracted"].alias("is_retracted"),
    )


def recited(paper: DataFrame, records: DataFrame) -> DataFrame:
    """`paper` with the citations of records (pmid, pubmed) rendered anew; all else as it was."""
    new = records.select(F.col("pmid").alias("_pmid"), reference(F.col("pubmed")).alias("_citation"))
    joined = paper.join(new, F.col("pmid") == F.col("_pmid"), "left")
    return joined.select(*(F.coalesce("_citation", "citation").alias(c) if c == "citation" else F.col(c) for c in paper.columns))


def cascade(paper: DataFrame, abstract: DataFrame) -> DataFrame:
    """The papers whose record is still there."""
    return paper.join(abstract, "pmid", "left_semi")


def working_corpus(abstract: DataFrame, paper: DataFrame) -> DataFrame:
    """Records whose full text is held."""
    return abstract.join(paper, "pmid", "left_semi")


def paper_view(abstract: DataFrame, paper: DataFrame) -> DataFrame:
    """Papers with title, journal, year and record read through from `abstract`."""
    record = abstract.select("pmid", F.col("pubmed.title").alias("title"), F.col("pubmed.journal").alias("journal"), "pub_year", F.col("pubmed").alias("record"))
    return paper.join(record, "pmid")


def with_paper(abstract: DataFrame, paper: DataFrame) -> DataFrame:
    """Every record, with its paper as a struct or NULL."""
    held = paper.select(F.col("pmid").alias("_pmid"), F.struct(*paper.columns).alias("paper"))
    return abstract.join(held, F.col("pmid") == F.col("_pmid"), "left").drop("_pmid")


def status(abstract: DataFrame, paper: DataFrame) -> DataFrame:
    """pmid and status: held, failed or untried.  A paper counts before a failure."""
    held = paper.select("pmid", F.lit(True).alias("_held"))
    value = F.when(F.col("_held"), "held").when(F.col("fetch_failed"), "failed").otherwise("untried")
    return abstract.join(held, "pmid", "left").select("pmid", value.alias("status"))


def candidates(
    abstract: DataFrame, paper: DataFrame, pmids: list[str] | None = None, retry: bool = False, recheck: bool = False, limit: int | None = None,
) -> DataFrame:
    """Records to fetch, newest first.

    With ids, those, whether held or not.  Otherwise records without a paper that haven't failed,
    with `retry` also all that have, with `recheck` those that failed with an id to fetch by.  An
    empty list of ids is as good as none.
    """
    if pmids:
        if len(pmids) <= MOST_LITERALS:
            queue = abstract.where(F.col("pmid").isin(pmids))
        else:
            wanted = abstract.sparkSession.createDataFrame([(p,) for p in pmids], "pmid string")
            queue = abstract.join(wanted, "pmid", "left_semi")
    else:
        eligible = [~F.col("fetch_failed")]
        if retry:
            eligible.append(F.col("fetch_failed"))
        if recheck:
            eligible.append(F.col("fetch_failed") & F.col("pmc_id").isNotNull())
        queue = abstract.join(paper, "pmid", "left_anti").where(reduce(or_, eligible))
    queue = queue.orderBy(F.col("pub_year").desc_nulls_last(), "pmid")
    return queue.limit(limit) if limit else queue


def match_articles(records: DataFrame, articles: DataFrame) -> DataFrame:
    """Records (pmid, pmc_id, ...) with their article as a struct or NULL: by article id, in
    either case, else by record number.  Of articles with the same id the last one counts."""
    value = F.struct(*articles.columns).alias("_article")
    order = [c for c in ("batch_id", "seq") if c in articles.columns]
    first = last_wins(articles.where("pmcid is not null").withColumn("_k1", F.upper("pmcid")), "_k1", *order).select("_k1", value.alias("_a1"))
    second = last_wins(articles.where("pmid is not null").withColumn("_k2", F.col("pmid")), "_k2", *order).select("_k2", value.alias("_a2"))
    # whole articles, which pack well: never sent to all, however small they are on disk
    found = records.join(first.hint("merge"), F.upper("pmc_id") == F.col("_k1"), "left").join(second.hint("merge"), F.col("pmid") == F.col("_k2"), "left")
    return found.select(*records.columns, F.coalesce("_a1", "_a2").alias("article"))


def outcomes(matched: DataFrame, paper: DataFrame) -> DataFrame:
    """What became of each record asked for: ok, no_pmcid, not_oa or failed.

    `matched` has pmid, pmc_id, pubmed (parsed from the stored record, NULL if it can't be), the
    article and whether its batch failed (batch_failed).  A new full text without a licence keeps
    the one that was held before.
    """
    old = paper.select(F.col("pmid").alias("_pmid"), F.col("fulltext.license").alias("_license"))
    body = has_body(F.col("article.fulltext.sections"))
    outcome = (
        F.when(F.col("pmc_id").isNull(), "no_pmcid").when(F.col("batch_failed"), "failed").when(F.col("article").isNull() | ~body, "not_oa")
        .when(F.col("pubmed").isNull(), "failed").otherwise("ok")
    )
    license_ = F.coalesce(F.nullif(F.col("article.fulltext.license"), F.lit("")), F.col("_license"))
    return (
        matched.join(old, F.col("pmid") == F.col("_pmid"), "left")
        .withColumn("outcome", outcome)
        .withColumn("fulltext", F.when(F.col("outcome") == "ok", F.col("article.fulltext").withField("license", license_)))
        .withColumn("jats_xml", F.col("article.jats_xml"))
        .withColumn("citation", F.when(F.col("outcome") == "ok", reference(F.col("pubmed"))))
        .drop("_pmid", "_license")
    )


def tally(settled: DataFrame) -> DataFrame:
    return settled.groupBy("outcome").agg(F.count("*").alias("n")).orderBy("outcome")


def cursor(abstract: DataFrame) -> DataFrame:
    """The latest entry date; NULL for an empty table."""
    return abstract.agg(F.max("entry_date").alias("cursor"))


def entered_between(df: DataFrame, since: Column, until: Column, column: str = "entry_date") -> DataFrame:
    return df.where(F.col(column).between(since, until))


def decade_histogram(abstract: DataFrame) -> DataFrame:
    return abstract.groupBy((F.floor(F.col("pub_year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


def license_tally(paper: DataFrame) -> DataFrame:
    return paper.groupBy(F.col("fulltext.license").alias("license")).agg(F.count("*").alias("n"))


def coverage(abstract: DataFrame, paper: DataFrame, *by: str) -> DataFrame:
    """Records, those with an article id, those held, and those that failed; of all, or by columns of `abstract`."""
    held = paper.select("pmid", F.lit(True).alias("_held"))
    return abstract.join(held, "pmid", "left").groupBy(*by).agg(
        F.count("*").alias("records"), F.count("pmc_id").alias("with_pmc_id"), F.count("_held").alias("held"), F.count_if("fetch_failed").alias("failed"),
        F.count("pubmed.abstract_text").alias("with_abstract"),
    )


def author_blocks(abstract: DataFrame) -> DataFrame:
    """How many author entries and records each blocking key has."""
    rows = abstract.select("pmid", F.explode("pubmed.authors").alias("a")).where(F.col("a.canonical_key").isNotNull())
    return rows.groupBy(F.col("a.canonical_key").alias("canonical_key")).agg(F.count("*").alias("entries"), F.countDistinct("pmid").alias("records"))


def definitions(config: DataFrame) -> DataFrame:
    """Corpus definitions, whatever the throughput settings, and when each was first used."""
    return config.groupBy("query", "year_min", "year_max", "max_records").agg(F.min("created_at").alias("first_used"))


#: Records of one day that are put in order in one task, about.
DAY_ROWS = 1 << 20


def definition_of(abstract: DataFrame, config: DataFrame) -> DataFrame:
    """pmid and the definition in force when the record arrived: the latest one recorded by then.

    Records and definitions are put on one line of time, day by day; the records of a full day are
    dealt to several lines, each with all definitions of the day.  A day begins with the last
    definition of the days before.  Of definitions recorded at once the one with the largest hash
    counts; without a time of arrival there is none.
    """
    marks = config.select(F.col("created_at").alias("at"), "config_hash").where("at is not null")
    rows = abstract.select(F.col("ingested_at").alias("at"), "pmid")
    day = F.to_date("at").alias("day")
    last = marks.groupBy(day).agg(F.max_by("config_hash", F.struct("at", "config_hash")).alias("closing"))
    days = rows.groupBy(day).agg(F.ceil(F.count("*") / DAY_ROWS).cast("int").alias("lines")).join(last, "day", "full")
    earlier = Window.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each day: a few ten thousand in a century
    days = F.broadcast(days.select("day", F.coalesce("lines", F.lit(0)).alias("lines"), F.last("closing", ignorenulls=True).over(earlier).alias("opening")))
    none = F.lit(None).cast("string")
    dealt = rows.withColumn("day", day).join(days, "day", "left").select("at", "pmid", "day", "opening", F.pmod(F.xxhash64("pmid"), F.coalesce("lines", F.lit(1))).cast("int").alias("line"), F.lit(True).alias("record"), none.alias("config_hash"))
    copied = marks.withColumn("day", day).join(days, "day").where("lines > 0")
    copied = copied.select("at", none.alias("pmid"), "day", none.alias("opening"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("line"), F.lit(False).alias("record"), "config_hash")
    within = Window.partitionBy("day", "line").orderBy("at", "record", "config_hash").rowsBetween(Window.unboundedPreceding, 0)
    carried = dealt.unionByName(copied).withColumn("found", F.last("config_hash", ignorenulls=True).over(within)).where("record")
    return carried.select("pmid", F.coalesce("found", "opening").alias("config_hash"))


def paper_sections(paper: DataFrame) -> DataFrame:
    """Sections in order, with the kind they have as read today."""
    rows = paper.select("pmid", F.posexplode("fulltext.sections").alias("position", "section"))
    return rows.select("pmid", "position", effective_type(F.col("section")).alias("type"), F.col("section.title").alias("title"), F.col("section.text").alias("text"))


def fetch_ids(records: DataFrame) -> DataFrame:
    """The ids to ask for, without prefix."""
    return records.where("pmc_id is not null").select(pmc_bare(F.col("pmc_id")).alias("id"))
