"""Every query of the catalogue against its SQL, on the driver's smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from foliant import queries, record_queries  # the second adds its queries to the first's
from foliant.plans.config import IngestConfig
from foliant.sources import remote

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(str(tuple(r[k] for k in place)) for r in want.fetchall())


def test_candidate_queue_is_a_top_k(spark):
    plan = queries.q03_candidate_queue(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LeftAnti" in plan


def test_reference_marks_are_cut_in_whole_texts(spark, con):
    got = {r.doc_id: r.v for r in queries.QUERIES["q21_reference_marks"](spark, str(DATA)).collect()}
    for doc, n in con.sql("SELECT doc_id, length(text) FROM documents").fetchall():
        assert n < 200 or len(got[doc]) > 150


@pytest.fixture
def larger(spark, tmp_path):
    """A table of more documents than the smallest has."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "concat('src', id % 7) AS source", "1L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_a_larger_table_has_more_batches_and_not_larger_ones(spark, larger):
    for xml, tag in ((record_queries.RECORD, "<PubmedArticle>"), (record_queries.ARTICLE, "<article>")):
        found = [bytes(r.payload).decode().count(tag) for r in record_queries.landing(spark, larger, xml).collect()]
        assert sum(found) == 3000 and max(found) <= queries.BATCH_ROWS


def test_jobs_bring_no_records_to_the_driver(spark, larger, monkeypatch):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{larger}/documents.parquet/*.parquet'")
    seen, collect = [0], DataFrame.collect

    def counted(frame):
        rows = collect(frame)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("a table is walked on the driver"))
    got = queries.QUERIES["q71_promote_and_relink"](spark, larger)
    assert max(seen) < 100
    monkeypatch.undo()
    want = con.sql(f"SELECT pmid, pmc_id, fetch_failed, status FROM ({queries.ORACLES['q71_promote_and_relink']})").fetchall()
    assert sorted(map(tuple, got.select("pmid", "pmc_id", "fetch_failed", "status").collect()), key=str) == sorted(want, key=str)


def test_searches_are_read_side_by_side(spark, larger, monkeypatch):
    monkeypatch.setattr(DataFrame, "collect", lambda *_: pytest.fail("a table is listed on the driver"))
    frame = queries.QUERIES["q65_paged_scan"](spark, larger)
    monkeypatch.undo()
    assert frame.rdd.getNumPartitions() > 1
    assert sorted(int(r.pmid) for r in frame.collect()) == [*range(3000)]
    pages = record_queries._scan(spark, larger, term="x").collect()
    assert max(bytes(r.payload).count(b"<PubmedArticle>") for r in pages) == 100 and len({r.batch_id for r in pages}) == len(pages)


def test_a_scan_with_a_rate_to_keep_is_one_task(spark, larger):
    config = IngestConfig("documents", "a@b.c", "t", rate_limit=1000, batch_size=100)
    pages = remote.scan(record_queries._searches(spark, larger).drop("ids"), config, record_queries.LISTED, "x")
    assert pages.rdd.getNumPartitions() == 1 and pages.count() == 30
