"""Queries on the driver's tables that each run one operator, with the SQL for the same result.

The tables stand in for the corpus: documents for records, labels for papers (some have one),
conversations for ordered lists, events.ts and orders.o_orderdate for dates.  Inputs that the
tables don't have (blank values, headings) are put in on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import citation, ids, records, sections, supplied, text
from foliant.operators import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records_of(spark: SparkSession, d: str) -> DataFrame:
    """documents in the shape of `abstract`: failed where the label says low quality."""
    failed = t(spark, d, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("_failed"))
    docs = t(spark, d, "documents").join(failed, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("pmid"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("int")).alias("pub_year"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("PMC"), F.col("doc_id"))).alias("pmc_id"), F.coalesce("_failed", F.lit(False)).alias("fetch_failed"), "lang", "source",
    )


#: Documents in a batch of XML, at most.
BATCH_ROWS = 400


def batch_of(number: Column) -> Column:
    """The batch of a document: neighbours by number, so that there are more batches in a larger table and not larger ones."""
    return F.floor(number / BATCH_ROWS)


def papers_of(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("pmid"), "toxic")


RECORDS = """WITH r AS (
  SELECT d.doc_id AS pmid, CASE WHEN d.doc_id % 7 <> 0 THEN CAST(n_chars AS INT) END AS pub_year, CASE WHEN d.doc_id % 3 <> 0 THEN 'PMC' || d.doc_id END AS pmc_id,
         l.doc_id IS NOT NULL AS fetch_failed, lang, source
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON d.doc_id = l.doc_id
), p AS (SELECT doc_id AS pmid, toxic FROM labels WHERE quality = 1) """


@query(RECORDS + "SELECT lang, count(*) AS records, count(p.pmid) AS held, count(pmc_id) AS with_pmc_id FROM r LEFT JOIN p ON r.pmid = p.pmid GROUP BY lang")
def q01_coverage(spark, d):
    rows = records_of(spark, d).withColumn("pubmed", F.struct(F.lit(None).cast("string").alias("abstract_text")))
    return corpus.coverage(rows, papers_of(spark, d), "lang").select("lang", "records", "held", "with_pmc_id")


@query(RECORDS + "SELECT pmid, lang FROM r WHERE pmid IN (SELECT pmid FROM p)")
def q02_working_corpus(spark, d):
    return corpus.working_corpus(records_of(spark, d), papers_of(spark, d)).select("pmid", "lang")


def _queue(where: str) -> str:
    return RECORDS + f"SELECT pmid, pub_year FROM r WHERE pmid NOT IN (SELECT pmid FROM p) AND ({where}) ORDER BY pub_year DESC NULLS LAST, pmid LIMIT 50"


@query(_queue("NOT fetch_failed"))
def q03_candidate_queue(spark, d):
    return corpus.candidates(records_of(spark, d), papers_of(spark, d), limit=50).select("pmid", "pub_year")


@query(_queue("NOT fetch_failed OR fetch_failed").replace(" LIMIT 50", ""))
def q04_eligibility_retry(spark, d):
    return corpus.candidates(records_of(spark, d), papers_of(spark, d), retry=True).select("pmid", "pub_year")


@query(_queue("NOT fetch_failed OR (fetch_failed AND pmc_id IS NOT NULL)").replace(" LIMIT 50", ""))
def q04b_eligibility_recheck(spark, d):
    return corpus.candidates(records_of(spark, d), papers_of(spark, d), recheck=True).select("pmid", "pub_year")


@query(RECORDS + "SELECT pmid, pub_year FROM r WHERE pmid IN (1, 5, 8, 13, 999999)")
def q05_in_list(spark, d):
    return corpus.candidates(records_of(spark, d), papers_of(spark, d), pmids=[1, 5, 8, 13, 999999]).select("pmid", "pub_year")


@query(_queue("NOT fetch_failed").replace(" LIMIT 50", ""))
def q05b_empty_in_list(spark, d):
    return corpus.candidates(records_of(spark, d), papers_of(spark, d), pmids=[]).select("pmid", "pub_year")


@query(RECORDS + "SELECT p.pmid, p.toxic, r.lang, r.pub_year FROM p JOIN r ON p.pmid = r.pmid")
def q06_read_through_view(spark, d):
    rows = records_of(spark, d).withColumn("pubmed", F.struct(F.col("lang").alias("title"), F.col("source").alias("journal")))
    return corpus.paper_view(rows, papers_of(spark, d)).select("pmid", "toxic", F.col("title").alias("lang"), "pub_year")


@query("SELECT max(CAST(ts AS DATE)) AS latest, CAST(max(CAST(ts AS DATE)) - INTERVAL 3 DAY AS DATE) AS since FROM events")
def q07_cursor(spark, d):
    latest = corpus.cursor(t(spark, d, "events").select(F.to_date("ts").alias("entry_date")))
    return latest.select(F.col("cursor").alias("latest"), F.date_sub("cursor", 3).alias("since"))


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT max(CAST(ts AS DATE)) - INTERVAL 3 DAY FROM events) AND (SELECT max(CAST(ts AS DATE)) FROM events)")
def q08_overlap_window(spark, d):
    events = t(spark, d, "events").withColumn("entry_date", F.to_date("ts"))
    latest = corpus.cursor(events).first()["cursor"]
    return corpus.entered_between(events, F.date_sub(F.lit(latest), 3), F.lit(latest)).select("event_id", "user_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q09_upsert_last_wins(spark, d):
    return corpus.last_wins(t(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT coalesce(o.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NOT NULL THEN s.lang ELSE o.lang END AS lang, o.source AS source, CASE WHEN o.doc_id IS NULL THEN 0 ELSE o.n_chars END AS n_chars
  FROM (SELECT * FROM documents WHERE doc_id % 5 <> 0) o FULL JOIN (SELECT doc_id, 'q' || quality AS lang FROM labels UNION ALL SELECT doc_id, 'new' AS lang FROM documents WHERE doc_id % 5 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)) s ON o.doc_id = s.doc_id""")
def q10_merge_columns(spark, d):
    """A fifth of the documents isn't known yet; of those that are, the labelled ones change."""
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    target = docs.where("doc_id % 5 <> 0").select("doc_id", "lang", "source", "n_chars")
    new = docs.where("doc_id % 5 = 0").join(labels, "doc_id", "left_anti").select("doc_id", F.lit("new").alias("lang"))
    source = labels.select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("lang")).unionByName(new)
    return corpus.merge_upsert(target, source, "doc_id", ["lang"], {"n_chars": F.lit(0)}, touch=None)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS c_name FROM customer")
def q11_insert_if_absent(spark, d):
    """All customers are offered, every second one is there."""
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    return corpus.insert_if_absent(c.where("c_custkey % 2 = 0"), c.withColumn("c_name", F.lit("new")), "c_custkey")


@query(RECORDS + """, s AS (SELECT CASE WHEN pmc_id IS NULL THEN 'no_pmcid' WHEN lang = 'de' THEN 'failed' WHEN p.pmid IS NULL THEN 'not_oa' ELSE 'ok' END AS outcome
  FROM r LEFT JOIN p ON r.pmid = p.pmid) SELECT outcome, count(*) AS n FROM s GROUP BY outcome""")
def q13_outcome_tally(spark, d):
    return corpus.tally(_settled(spark, d))


def _settled(spark, d):
    body = F.array(F.struct(F.lit("other").alias("type"), F.lit(None).cast("string").alias("title"), F.lit("x").alias("text")))
    full = F.struct(F.lit(None).cast("string").alias("license"), body.alias("sections"))
    articles = papers_of(spark, d).select(F.col("pmid").cast("string").alias("pmid"), F.lit(None).cast("string").alias("pmcid"), F.lit("<a/>").alias("jats_xml"), full.alias("fulltext"))
    asked = records_of(spark, d).select(F.col("pmid").cast("string").alias("pmid"), "pmc_id", (F.col("lang") == "de").alias("batch_failed"), _stub(F.col("pmid").cast("string")).alias("pubmed"))
    held = spark.createDataFrame([], "pmid string, fulltext struct<license:string>")
    return corpus.outcomes(corpus.match_articles(asked, articles), held)


def _stub(pmid: Column) -> Column:
    empty = F.lit(None).cast("string")
    people = F.lit(None).cast("array<struct<position:int,last_name:string,fore_name:string,initials:string,collective_name:string>>")
    return F.struct(people.alias("authors"), empty.alias("title"), empty.alias("journal"), F.lit(None).cast("int").alias("pub_year"), *(empty.alias(c) for c in ("volume", "issue", "pages", "doi")), pmid.alias("pmid"))


@query("""SELECT o.o_orderkey, coalesce(a.c_name, b.c_name) AS c_name FROM orders o
  LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) a ON upper('k' || o.o_custkey) = upper('K' || a.c_custkey)
  LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 = 0) b ON o.o_orderkey = b.c_custkey""")
def q14_dual_key_match(spark, d):
    c = t(spark, d, "customer")
    key = F.col("c_custkey")
    articles = c.where((key % 3 == 0) | (key % 5 == 0)).select(
        F.when(key % 3 == 0, F.concat(F.lit("K"), key)).alias("pmcid"), F.when(key % 5 == 0, key.cast("string")).alias("pmid"), "c_name", F.lit("b").alias("batch_id"), key.cast("int").alias("seq")
    )
    asked = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.concat(F.lit("k"), F.col("o_custkey")).alias("pmc_id"), "o_orderkey")
    return corpus.match_articles(asked, articles).select("o_orderkey", F.col("article.c_name").alias("c_name"))


@query("""SELECT e.event_id, s.name AS definition FROM events e ASOF LEFT JOIN
  (SELECT TIMESTAMP '2024-01-05 00:00:00' AS at, 'a' AS name UNION ALL SELECT TIMESTAMP '2024-01-12 06:30:00', 'b' UNION ALL SELECT TIMESTAMP '2024-01-20 00:00:00', 'c') s ON e.ts >= s.at""")
def q15_asof_definition(spark, d):
    marks = spark.sql("SELECT timestamp'2024-01-05 00:00:00' AS created_at, 'a' AS config_hash UNION ALL SELECT timestamp'2024-01-12 06:30:00', 'b' UNION ALL SELECT timestamp'2024-01-20 00:00:00', 'c'")
    rows = t(spark, d, "events").select(F.col("event_id").alias("pmid"), F.col("ts").cast("timestamp").alias("ingested_at"))
    return corpus.definition_of(rows, marks).select(F.col("pmid").alias("event_id"), F.col("config_hash").alias("definition"))


@query("SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS decade, count(*) AS n FROM orders GROUP BY 1")
def q16_decade_histogram(spark, d):
    return corpus.decade_histogram(t(spark, d, "orders").select(F.year("o_orderdate").alias("pub_year")))


LICENSE = """SELECT doc_id, CASE WHEN c <> '' THEN 'CC ' || upper(c) WHEN contains(lower(x), 'creativecommons.org/publicdomain/zero') THEN 'CC0' WHEN source IN ('src1', 'src2') THEN source
  ELSE nullif(left(CASE WHEN doc_id % 6 = 5 THEN '' ELSE text END, 100), '') END AS license
  FROM (SELECT *, regexp_extract(x, '(?i)creativecommons\\.org/licenses/([a-z\\-]+)', 1) AS c FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'https://CreativeCommons.org/licenses/by-nc/4.0' WHEN 1 THEN 'http://creativecommons.org/publicdomain/zero/1.0/' ELSE '' END AS x FROM documents))"""


def _licensed(spark, d):
    href = F.when(F.col("doc_id") % 4 == 0, "https://CreativeCommons.org/licenses/by-nc/4.0").when(F.col("doc_id") % 4 == 1, "http://creativecommons.org/publicdomain/zero/1.0/").otherwise("")
    declared = F.when(F.col("source").isin("src1", "src2"), F.col("source"))
    body = F.when(F.col("doc_id") % 6 == 5, "").otherwise(F.col("text"))
    return t(spark, d, "documents").select("doc_id", sections.license_label(href, declared, body).alias("license"))


@query(LICENSE)
def q17_license_label(spark, d):
    return _licensed(spark, d)


@query(f"SELECT license, count(*) AS n FROM ({LICENSE}) GROUP BY license")
def q18_license_tally(spark, d):
    return corpus.license_tally(_licensed(spark, d).select(F.struct("license").alias("fulltext")))


@query("SELECT doc_id, nullif(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), '') AS collapsed FROM documents")
def q19_ws_collapse(spark, d):
    return t(spark, d, "documents").select("doc_id", text.collapsed(F.col("text")).alias("collapsed"))


BLANKS = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' || chr(10) || chr(9) WHEN 2 THEN ' x ' ELSE source END"


@query(f"SELECT doc_id, CASE WHEN regexp_full_match(v, '\\s*') THEN NULL ELSE v END AS v FROM (SELECT doc_id, {BLANKS} AS v FROM documents)")
def q20_blank_to_null(spark, d):
    return t(spark, d, "documents").select("doc_id", text.blank_to_null(F.expr(BLANKS)).alias("v"))


@query("SELECT doc_id, regexp_replace(v, '([a-z]{3,})\\.\\d+(?:[,–-]\\d+)*', '\\1.', 'g') AS v FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' years.1,3 and' WHEN 1 THEN ' in 2013.5 units' ELSE ' text.4–7' END AS v FROM documents)")
def q21_reference_marks(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, " years.1,3 and").when(F.col("doc_id") % 3 == 1, " in 2013.5 units").otherwise(" text.4–7")
    return t(spark, d, "documents").select("doc_id", supplied.clean(F.concat("text", tail)).alias("v"))


HEADINGS = ["Introduction", "BACKGROUND", "Materials and methods", "Results and discussion", "Summary", "Key findings", "Preferences", "Study design", "Final remarks", "Case 1", "but this finding", "Methods.", "A very long heading on methods and results", "Conflict of interest", "Outcomes", "Aims"]
KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(h), '{p}') THEN '{k}'" for k, p in sections.PATTERNS) + " ELSE 'other' END"
VALUES = "(VALUES " + ", ".join(f"({k}, '{h}')" for k, h in enumerate(HEADINGS)) + ") AS v(k, h)"


def _headed(spark, d):
    at = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % len(HEADINGS) + 1).cast("int"))
    return t(spark, d, "documents").select("doc_id", "source", at.alias("h"))


@query(f"SELECT doc_id, h, h <> '' AND length(h) <= 30 AND regexp_matches(h, '^[A-Z]') AND NOT regexp_matches(h, '[.,;:]$') AND (lower(h) IN ('abstract', 'summary') OR {KIND} <> 'other') AS heading FROM documents JOIN {VALUES} ON doc_id % {len(HEADINGS)} = k")
def q22_heading_lines(spark, d):
    return _headed(spark, d).select("doc_id", "h", supplied.is_heading(F.col("h")).alias("heading"))


@query("SELECT doc_id, 'one' || chr(32) || source || chr(10) || chr(10) || 'two' AS unwrapped FROM documents")
def q23_unwrap_paragraphs(spark, d):
    raw = F.concat(F.lit("Introduction\n one\n"), F.col("source"), F.lit(" \n\n \ntwo\n"))
    parsed = supplied.parse_supplied(raw)
    return t(spark, d, "documents").select("doc_id", parsed["sections"][0]["text"].alias("unwrapped"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages")
def q24_title_extract(spark, d):
    return t(spark, d, "pages").select("page_id", text.flat(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT page_id, nullif(array_to_string(list_filter(list_transform(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: trim(regexp_replace(x, '[ \\t\\n\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)), '') AS paragraphs FROM pages")
def q25_paragraphs(spark, d):
    found = F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1), text.collapsed)
    return t(spark, d, "pages").select("page_id", text.joined(found, "\n\n").alias("paragraphs"))


@query(f"SELECT doc_id, h, {KIND} AS kind FROM documents JOIN {VALUES} ON doc_id % {len(HEADINGS)} = k")
def q26_classify_sections(spark, d):
    return _headed(spark, d).select("doc_id", "h", sections.classify(F.lit(None).cast("string"), F.col("h")).alias("kind"))


STORED = "CASE doc_id % 3 WHEN 0 THEN 'methods' WHEN 1 THEN 'other' ELSE NULL END"


@query(f"SELECT doc_id, CASE WHEN coalesce(s, 'other') <> 'other' THEN s ELSE {KIND} END AS kind FROM (SELECT doc_id, h, {STORED} AS s FROM documents JOIN {VALUES} ON doc_id % {len(HEADINGS)} = k)")
def q27_effective_type(spark, d):
    section = F.struct(F.expr(STORED).alias("type"), F.col("h").alias("title"))
    return _headed(spark, d).select("doc_id", section.alias("s")).select("doc_id", sections.effective_type(F.col("s")).alias("kind"))


def _turns(spark, d):
    turn = F.struct("turn", F.col("role").alias("type"), F.lit(None).cast("string").alias("title"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")).alias("text"))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("sections"))


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' AND turn % 4 <> 3 AND text <> '' THEN text END, chr(10) || chr(10) ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id")
def q28_section_text(spark, d):
    return _turns(spark, d).select("conv_id", sections.section_text(F.col("sections"), "user").alias("said"))


@query("SELECT conv_id, bool_or(turn > 2 AND turn % 4 <> 3 AND text <> '') AS has_body FROM conversations GROUP BY conv_id")
def q29_has_body(spark, d):
    late = F.transform("sections", lambda s: F.struct(s["turn"].alias("turn"), F.when(s["turn"] > 2, s["text"]).alias("text")))
    return _turns(spark, d).select("conv_id", sections.has_body(late).alias("has_body"))


@query("SELECT conv_id, string_agg(role, ';' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def q30_ordered_join(spark, d):
    return _turns(spark, d).select("conv_id", text.joined(F.transform("sections", lambda s: s["type"]), ";").alias("roles"))


@query("SELECT conv_id, array_to_string((list(role || turn ORDER BY turn, role))[1:6], ', ') || CASE WHEN count(*) > 6 THEN ', et al' ELSE '' END AS authors FROM conversations GROUP BY conv_id")
def q31_et_al(spark, d):
    none = F.lit(None).cast("string")
    people = F.transform("sections", lambda s: F.struct(s["turn"].alias("position"), F.concat(s["type"], s["turn"]).alias("last_name"), none.alias("fore_name"), none.alias("initials"), none.alias("collective_name")))
    return _turns(spark, d).select("conv_id", citation.authors(people).alias("authors"))


PARTS = """CASE WHEN o_orderkey % 5 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS y, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS v,
  CASE WHEN o_orderkey % 2 <> 0 THEN left(o_orderpriority, 1) END AS i, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS STRING) END AS p"""
LOCATOR = """nullif(coalesce(CAST(y AS STRING), '') || coalesce(CASE WHEN y IS NULL THEN v ELSE ';' || v END, '') || coalesce('(' || i || ')', '')
  || coalesce(CASE WHEN v IS NOT NULL OR i IS NOT NULL THEN ':' || p WHEN y IS NOT NULL THEN ';' || p ELSE p END, ''), '')"""


def _parts(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("_orders_parts")
    return spark.sql(f"SELECT o_orderkey, o_custkey, {PARTS} FROM _orders_parts")


@query(f"SELECT o_orderkey, {LOCATOR} AS locator FROM (SELECT o_orderkey, {PARTS} FROM orders)")
def q32_locator(spark, d):
    return _parts(spark, d).select("o_orderkey", citation.locator(F.col("y"), F.col("v"), F.col("i"), F.col("p")).alias("locator"))


@query(f"""SELECT o_orderkey, concat_ws(' ', c_name || '.', CASE WHEN o_orderkey % 4 = 0 THEN 'Why?' WHEN o_orderkey % 4 = 1 THEN 'Title.' WHEN o_orderkey % 4 = 2 THEN 'T.' END, c_mktsegment || '.',
  {LOCATOR} || '.', CASE WHEN o_orderkey % 3 = 1 THEN 'doi:10.1/' || o_orderkey ELSE 'PMID: ' || o_orderkey END) AS reference
  FROM (SELECT o_orderkey, o_custkey, {PARTS} FROM orders) JOIN customer ON o_custkey = c_custkey""")
def q33_reference(spark, d):
    none, key = F.lit(None).cast("string"), F.col("o_orderkey")
    title = F.when(key % 4 == 0, "Why?").when(key % 4 == 1, " Title. ").when(key % 4 == 2, "T")
    people = F.array(F.struct(F.lit(1).alias("position"), F.col("c_name").alias("last_name"), none.alias("fore_name"), none.alias("initials"), none.alias("collective_name")))
    record = F.struct(people.alias("authors"), title.alias("title"), F.concat("c_mktsegment", F.lit(".")).alias("journal"), F.col("y").alias("pub_year"), F.col("v").alias("volume"), F.col("i").alias("issue"), F.col("p").alias("pages"), key.cast("string").alias("pmid"), F.when(key % 3 == 1, F.concat(F.lit("10.1/"), key)).alias("doi"))
    return _parts(spark, d).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(key, citation.reference(record).alias("reference"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1/' || doc_id END AS url,
  CASE WHEN doc_id % 2 = 0 THEN 'doi:10.1/' || doc_id WHEN doc_id % 3 <> 0 THEN 'PMID: ' || doc_id ELSE '' END AS identifier FROM documents""")
def q34_identifier_url(spark, d):
    pmid, doi = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" 10.1/"), F.col("doc_id")))
    return t(spark, d, "documents").select("doc_id", ids.reference_url(pmid, doi).alias("url"), citation.identifier(pmid, doi).alias("identifier"))


def _key(last: str = "regexp_extract(c_name, '^([A-Za-z]+)', 1)") -> str:
    return f"lower({last}) || '|' || lower(left(c_mktsegment, 1))"


@query(f"SELECT c_custkey, {_key()} AS canonical_key FROM customer")
def q35_canonical_key(spark, d):
    return t(spark, d, "customer").select("c_custkey", ids.canonical_key(F.regexp_extract("c_name", "^([A-Za-z]+)", 1), F.col("c_mktsegment"), F.lit("Z")).alias("canonical_key"))


@query(f"SELECT {_key()} AS canonical_key, count(*) AS entries, count(DISTINCT c_nationkey) AS records FROM customer GROUP BY 1")
def q36_blocking_groups(spark, d):
    key = ids.canonical_key(F.regexp_extract("c_name", "^([A-Za-z]+)", 1), F.col("c_mktsegment"), F.lit("Z"))
    authors = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("pmid")).agg(F.collect_list(F.struct(key.alias("canonical_key"))).alias("authors"))
    return corpus.author_blocks(authors.select("pmid", F.struct("authors").alias("pubmed")))


@query("SELECT o_orderstatus AS query, CAST(year(o_orderdate) AS INT) AS year_min, CAST(NULL AS INT) AS year_max, CAST(NULL AS INT) AS max_records, min(CAST(o_orderdate AS DATE)) AS first_used FROM orders GROUP BY 1, 2")
def q38_definitions_distinct(spark, d):
    none = F.lit(None).cast("int")
    rows = t(spark, d, "orders").select(F.col("o_orderstatus").alias("query"), F.year("o_orderdate").alias("year_min"), none.alias("year_max"), none.alias("max_records"), F.to_date("o_orderdate").alias("created_at"))
    return corpus.definitions(rows)


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def q40_json_field(spark, d):
    return t(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


@query("SELECT lexeme, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS lexeme FROM documents) GROUP BY lexeme")
def q41_token_df(spark, d):
    from foliant.operators import search

    none = F.lit(None).cast("string")
    frame = t(spark, d, "documents").select(F.col("doc_id").alias("pmid"), F.struct(none.alias("title"), F.col("text").alias("abstract_text"), F.array().cast("array<string>").alias("mesh_terms")).alias("pubmed"))
    return search.inverted(frame).where("config = 'simple'").groupBy("lexeme").agg(F.count("*").alias("df"))  # a row for each record: all text is in one field


@query("""SELECT doc_id AS pmid, CAST(round(0.4 * sum(CASE WHEN w IN ('the', 'with') THEN 1 ELSE 0 END), 6) AS DOUBLE) AS rank FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents)
  GROUP BY doc_id HAVING count(DISTINCT CASE WHEN w IN ('the', 'with') THEN w END) = 2""")
def q42_weighted_search(spark, d):
    from foliant.operators import search

    none = F.lit(None).cast("string")
    frame = t(spark, d, "documents").select(F.col("doc_id").alias("pmid"), F.struct(none.alias("title"), F.col("text").alias("abstract_text"), F.array().cast("array<string>").alias("mesh_terms")).alias("pubmed"))
    return search.search(search.inverted(frame).where("config = 'simple'"), search.parse_query("the with", "simple"))


@query("SELECT conv_id, bool_or(lower(trim(r)) = 'retracted publication') AS is_retracted FROM (SELECT conv_id, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN ' Retracted Publication' ELSE role END AS r FROM conversations) GROUP BY conv_id")
def q43_retraction_flag(spark, d):
    kind = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), " Retracted Publication").otherwise(F.col("role"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(kind).alias("types"))
    return rows.select("conv_id", ids.is_retracted(F.col("types")).alias("is_retracted"))


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid, source AS title, lang AS journal, CAST(2000 + doc_id % 20 AS INT) AS year FROM documents")
def q44_parse_records(spark, d):
    """Records made of documents, landed as XML batches and parsed."""
    xml = F.format_string(
        "<PubmedArticle><MedlineCitation><PMID>%d</PMID><Article><Journal><JournalIssue><PubDate><Year>%d</Year></PubDate></JournalIssue><Title>%s</Title></Journal><ArticleTitle> <b>%s</b></ArticleTitle></Article></MedlineCitation></PubmedArticle>",
        "doc_id", 2000 + F.col("doc_id") % 20, "lang", "source",
    )
    body = F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.collect_list(xml), ""), F.lit("</PubmedArticleSet>"))
    landing = t(spark, d, "documents").groupBy(batch_of(F.col("doc_id")).cast("string").alias("batch_id")).agg(body.cast("binary").alias("payload")).withColumn("kind", F.lit("pubmed"))
    p = F.col("pubmed")
    return records.read_records(landing).select(p["pmid"].alias("pmid"), p["title"].alias("title"), p["journal"].alias("journal"), p["pub_year"].alias("year"))


@query("SELECT doc_id % 97 AS k, max(doc_id) AS seq FROM documents GROUP BY 1")
def q45_overlap_last_wins(spark, d):
    rows = t(spark, d, "documents").select((F.col("doc_id") % 97).alias("k"), F.col("doc_id").alias("seq"))
    return corpus.last_wins(rows, "k", "seq")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return q01_coverage(spark, d)


