import json
import sys
from bisect import bisect_right
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import fakes
import pytest
from fakes import FakeClient, article, record
from pyspark.sql import functions as F

from foliant.functions.supplied import SeedError, parse_text
from foliant.operators import corpus, search
from foliant.plans import jobs
from foliant.plans.config import IngestConfig, build_query, incremental_term
from foliant.schemas import CORPUS_CONFIG, PAPER
from foliant.sources import mirror, remote, snapshot
from foliant.sources.tables import Store
from foliant.streaming.ingest import ingest

CONFIG = IngestConfig("asthma", "a@b.c", "t", rate_limit=0, batch_size=2, pmc_batch_size=2)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def pmids(df):
    return sorted(r.pmid for r in df.collect())


def test_config():
    for wrong in ({"query": " "}, {"ncbi_api_key": ""}, {"batch_size": 0}, {"rate_limit": -1}, {"max_records": 0}, {"year_min": 2001, "year_max": 2000}):
        with pytest.raises(ValueError):
            IngestConfig(**({"query": "q", "ncbi_email": "e", "ncbi_tool": "t"} | wrong))
    keyed = IngestConfig("asthma", "a@b.c", "t", "key", rate_limit=0, batch_size=2, pmc_batch_size=2)
    assert keyed.config_hash() == CONFIG.config_hash() and "key" not in json.dumps(keyed.recorded())
    assert build_query(CONFIG) == "(asthma)" and build_query(CONFIG, year_min=1990) == "(asthma) AND 1990:3000[dp]"
    assert build_query(CONFIG, "x", 0, 2000) == "(x) AND 1800:2000[dp]"
    assert incremental_term(CONFIG, date(2020, 1, 2), date(2020, 2, 3)) == "(asthma) AND 2020/01/02:2020/02/03[edat]"


def test_sync(store):
    client = FakeClient([record("1", pmc="11"), record("2", entrez=("2020", "3", "1")), record("3"), record("1", "Newer")])
    assert jobs.sync(store, client, CONFIG) == 4
    abstract = store.read("abstract")
    assert pmids(abstract) == ["1", "2", "3"] and client.calls == [(0, 2), (2, 2)] and client.terms == ["(asthma)"]
    row = abstract.where("pmid = '1'").first()
    assert row.pubmed.title == "Newer" and row.pmc_id is None and row.fetch_failed is False and row.ingested_at
    # what fetching found out stays, and so does when a record first came
    store.write("abstract", abstract.withColumn("fetch_failed", F.col("pmid") == "2"))
    again = FakeClient([record("2", "Changed", entrez=("2020", "3", "1")), record("4")])
    assert jobs.sync(store, again, CONFIG, today=date(2020, 5, 5)) == 2
    assert again.terms == ["(asthma) AND 2020/02/27:2020/05/05[edat]"]
    rows = {r.pmid: r for r in store.read("abstract").collect()}
    assert len(rows) == 4 and rows["2"].fetch_failed and rows["2"].pubmed.title == "Changed" and rows["1"].ingested_at == row.ingested_at
    assert store.read("corpus_config").count() == 1
    assert jobs.sync(store, FakeClient(), CONFIG) == 0


def test_sync_caps_and_failures(store):
    capped = IngestConfig("q", "a@b.c", "t", rate_limit=0, batch_size=2, max_records=3)
    client = FakeClient([record(str(k)) for k in range(9)])
    assert jobs.sync(store, client, capped) == 3 and client.calls == [(0, 2), (2, 1)]
    down = FakeClient([record(str(k)) for k in range(10, 16)], fail_at=2)
    with pytest.raises(OSError):
        jobs.sync(store, down, CONFIG, full=True)
    assert store.read("abstract").count() == 7 and store.read("corpus_config").count() == 2


def test_fetch(store):
    records = [record("1", pmc="PMC1"), record("2", pmc="PMC2"), record("3"), record("4", pmc="PMC4"), record("5", pmc="PMC666"), record("6", pmc="PMC6")]
    jobs.sync(store, FakeClient(records), CONFIG)
    full = {"PMC1": article("1", "PMC1"), "PMC2": article("2", "PMC2", ""), "PMC4": article("4", "9"), "PMC6": article("6", "pmc6")}
    got = jobs.fetch_fulltext(store, FakeClient(full=full), CONFIG, batch_size=1)
    assert got == {"ok": 3, "not_oa": 1, "no_pmcid": 1, "failed": 1}  # 4 is found by its record number
    abstract, paper = store.read("abstract"), store.read("paper")
    assert pmids(paper) == ["1", "4", "6"] and pmids(abstract.where("fetch_failed")) == ["2", "3", "5"]
    assert paper.where("pmid = '1'").first().citation == "Name0 AA. A study. J Tests. 2019;3(2):10-9. PMID: 1"
    assert {r.pmid: r.status for r in corpus.status(abstract, paper).collect()} == {"1": "held", "4": "held", "6": "held", "2": "failed", "3": "failed", "5": "failed"}
    assert pmids(corpus.candidates(abstract, paper)) == [] and jobs.fetch_fulltext(store, FakeClient(), CONFIG) == {}
    assert pmids(corpus.candidates(abstract, paper, retry=True)) == ["2", "3", "5"]
    assert pmids(corpus.candidates(abstract, paper, recheck=True)) == ["2", "5"] and pmids(corpus.candidates(abstract, paper, pmids=[])) == []
    assert [r.pmid for r in corpus.candidates(abstract, paper, pmids=["6", "1"], limit=1).collect()] == ["1"]
    # a licence that a new text lacks is kept, and an id that is looked up is stored
    new = {"PMC1": article("1", "PMC1", license_=""), "PMC3": article("3", "PMC3")}
    assert jobs.fetch_fulltext(store, FakeClient(full=new, links={"3": "PMC3"}), CONFIG, pmids=["1", "3"], relink=True) == {"ok": 2}
    paper = store.read("paper")
    assert paper.where("pmid = '1'").first().fulltext.license == "CC BY-NC"
    assert store.read("abstract").where("pmid = '3'").first().pmc_id == "PMC3"
    view = {r.pmid: (r.title, r.journal, r.pub_year) for r in corpus.paper_view(store.read("abstract"), paper).collect()}
    assert view["3"] == ("A study", "J Tests.", 2019)
    assert {(r.license, r.n) for r in corpus.license_tally(paper).collect()} == {("CC BY-NC", 4)}
    c = corpus.coverage(store.read("abstract"), paper).first()
    assert (c.records, c.held, c.failed) == (6, 4, 2)
    assert [(r.pmid, r.type) for r in corpus.paper_sections(paper).where("pmid = '1'").collect()] == [("1", "discussion")]
    assert pmids(corpus.cascade(paper, store.read("abstract").where("pmid <> '1'"))) == ["3", "4", "6"]
    assert jobs.reparse(store) == 6 and store.read("paper").count() == 4


def test_a_bulk_client_gives_the_same_as_one_call_after_the_other(store, spark, tmp_path):
    held = [str(k) for k in range(1, 12)]
    found = {p: record(p, pmc=p if int(p) % 2 else None) for p in held}
    full, links = {p: article(p, f"PMC{p}", "" if p == "3" else "<p>x</p>") for p in held if int(p) % 5}, {p: f"PMC{p}" for p in held if int(p) % 4 == 0}
    walked = mirror.Mirror(found, full, links)
    tables = mirror.Tables(spark.createDataFrame([*found.items()], "pmid string, xml string"), spark.createDataFrame([*full.items()], "id string, xml string"), spark.createDataFrame([*links.items()], "pmid string, pmc_id string"))
    assert isinstance(tables, remote.Bulk) and not isinstance(walked, remote.Bulk)
    other = Store(spark, f"file://{tmp_path}/bulk")
    for relink in (False, True):
        got = [(jobs.sync(s, c, CONFIG, full=True), jobs.fetch_fulltext(s, c, CONFIG, retry=relink, relink=relink)) for s, c in ((store, walked), (other, tables))]
        assert got[0] == got[1] and got[0][1]["ok"] > 0
        columns = ["pmid", "pubmed_xml", "pubmed", "entry_date", "pub_year", "pmc_id", "is_retracted", "fetch_failed"]
        assert sorted(store.read("abstract").select(columns).collect()) == sorted(other.read("abstract").select(columns).collect())
        assert sorted(store.read("paper").collect(), key=str) == sorted(other.read("paper").collect(), key=str)
    pages = other.landed().where("kind = 'pubmed'").collect()
    assert len(pages) > 2 and max(bytes(r.payload).count(b"<PubmedArticle>") for r in pages) <= CONFIG.batch_size
    assert jobs.sync(other, tables, IngestConfig("q", "a@b.c", "t", rate_limit=0, batch_size=2, max_records=5), full=True) == 5
    # the single calls
    assert sorted(tables.fetch_batch("", "", 2, 3).decode()) == sorted(mirror.Mirror({p: found[p] for p in sorted(held)}).fetch_batch("", "", 2, 3).decode())
    assert tables.fetch_pmids(["4"]) == walked.fetch_pmids(["4"]) and tables.fetch_pmc(["PMC4"]) == walked.fetch_pmc(["PMC4"]) and tables.elink_pmcid("8") == "PMC8" and tables.elink_pmcid("3") is None


def test_a_queue_is_read_batch_by_batch():
    ids = iter(range(10))
    assert next(remote.batches(ids, 3)) == [0, 1, 2] and next(ids) == 3
    assert [*remote.batches("abcde", 2)] == [["a", "b"], ["c", "d"], ["e"]]


def test_interrupted_fetch_keeps_what_is_settled(store):
    class Interrupted(FakeClient):
        def fetch_pmc(self, ids):
            if self.calls:
                raise KeyboardInterrupt
            return super().fetch_pmc(ids)

    jobs.sync(store, FakeClient([record("1", pmc="PMC1"), record("2", pmc="PMC2")]), CONFIG)
    with pytest.raises(KeyboardInterrupt):
        jobs.fetch_fulltext(store, Interrupted(full={"PMC1": article("1", "PMC1"), "PMC2": article("2", "PMC2")}), CONFIG, batch_size=1)
    assert pmids(store.read("paper")) == ["1"] and pmids(corpus.candidates(store.read("abstract"), store.read("paper"))) == ["2"]


def test_snapshot_round_trip(store, spark, tmp_path):
    jobs.sync(store, FakeClient([record("2", pmc="PMC2", authors=2), record("1", "é", entrez=None)]), CONFIG)
    jobs.fetch_fulltext(store, FakeClient(full={"PMC2": article("2", "PMC2")}), CONFIG)
    path = f"file://{tmp_path}/snap"
    assert jobs.export_snapshot(store, path) == 2
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert [x["pmid"] for x in lines] == ["1", "2"] and "paper" not in lines[0] and lines[0]["entry_date"] is None and lines[0]["pubmed_json"]["title"] == "é"
    assert lines[1]["paper"]["fulltext_jats"]["license"] == "CC BY-NC" and lines[1]["pubmed_json"]["pub_date"] == "2019-03-07"
    other = Store(spark, f"file://{tmp_path}/other")
    assert jobs.import_snapshot(other, path) == 2
    columns = ["pmid", "pubmed_xml", "pubmed", "entry_date", "pub_year", "pmc_id", "is_retracted", "fetch_failed"]
    assert sorted(other.read("abstract").select(columns).collect()) == sorted(store.read("abstract").select(columns).collect())
    assert other.read("paper").collect() == store.read("paper").collect()
    assert jobs.import_snapshot(other, path, batch_files=True) == 2 and other.read("abstract").count() == 2
    for bad in ('{"pmid": "1", "raw_xml": "x"}', '{"pmid": "1", "authors": []}', "nonsense"):
        with pytest.raises(Exception, match="LEGACY_SHAPE|BAD_LINE"):
            snapshot.decode(spark.createDataFrame([(bad,), (" ",)], "value string")).collect()
    assert snapshot.decode(spark.createDataFrame([(" ",), ("",)], "value string")).count() == 0


def test_seed(store):
    jobs.sync(store, FakeClient([record("1")]), CONFIG)
    store.write("abstract", store.read("abstract").withColumn("fetch_failed", F.lit(True)))
    payload = parse_text("Title\nIntroduction\nText here\n")
    jobs.seed_paper(store, "1", payload)
    jobs.seed_paper(store, "1", payload)
    row = store.read("paper").first()
    assert row.fulltext.sections[0].type == "intro" and row.citation.startswith("Name0 AA. A study.") and store.read("paper").count() == 1
    assert not store.read("abstract").first().fetch_failed
    for pmid, broken in (("9", payload), ("1", payload | {"sections": []})):
        with pytest.raises(SeedError):
            jobs.seed_paper(store, pmid, broken)


def test_store(store):
    store.create()
    assert store.read("abstract").count() == 0 and store.version("paper") == 1
    store.create()
    assert store.version("paper") == 1
    store.drop()
    assert store.version("paper") is None and store.landed().count() == 0


def test_a_writer_that_dies_anywhere_leaves_the_state(store, monkeypatch):
    def papers(*ids):
        return store.spark.createDataFrame([(p, None, None, None) for p in ids], PAPER)

    store.create()
    store.commit({"paper": papers("1"), "abstract": store.read("abstract")})
    before = store.state()

    def dies(*_):
        raise KeyboardInterrupt

    # before the log entry; over it; after it
    monkeypatch.setattr(store, "_log", dies)
    with pytest.raises(KeyboardInterrupt):
        store.commit({"paper": papers("2")})
    monkeypatch.undo()
    assert store.state() == before and pmids(store.read("paper")) == ["1"]
    path = store._path("_log", f"{before['tables']['paper'] + 1:012d}")
    store._fs(path).create(path, False).close()
    assert store.state() == before and pmids(store.read("paper")) == ["1"]
    monkeypatch.setattr(store, "_tidy", dies)
    with pytest.raises(KeyboardInterrupt):
        store.write("paper", papers("1", "2"))
    monkeypatch.undo()
    assert pmids(store.read("paper")) == ["1", "2"] and store.version("abstract") == before["tables"]["abstract"]
    for k in range(6):
        store.write("paper", papers(str(k)))
    assert pmids(store.read("paper")) == ["5"] and store.read("abstract").count() == 0
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        store._log(store._entries()[0], {})


def test_schema_versions(store):
    store.create()
    jobs.sync(store, FakeClient([record("1")]), CONFIG)
    assert store.state()["schema"] == 2 and store.read("corpus_config").count() == 1
    store.migrate(1)
    assert store.state()["schema"] == 1 and store.version("corpus_config") is None and store.read("abstract").count() == 1
    store.migrate(2)
    assert store.state()["schema"] == 2 and store.read("corpus_config").count() == 0 and store.read("abstract").count() == 1
    store.migrate(0)
    assert store.state() == {"schema": 0, "tables": {}} and store.read("abstract").count() == 0
    with pytest.raises(ValueError):
        store.migrate(3)


def test_a_sync_reads_only_its_own_pages(store):
    jobs.sync(store, FakeClient([record("1")]), CONFIG)
    jobs.sync(store, FakeClient([record("2"), record("3"), record("4")]), CONFIG, full=True)
    runs = {r.batch_id.rpartition("-")[0] for r in store.landed().collect()}
    assert len(runs) == 2 and store.landed().count() == 3
    for run in runs:
        assert {r.batch_id.rpartition("-")[0] for r in store.landed(run).collect()} == {run} and all(f"run={run}/" in f for f in store.landed(run).inputFiles())


def test_definitions(spark, monkeypatch):
    def at(day):
        return datetime(2020, 1, day, tzinfo=timezone.utc)

    rows = [("h1", "q", None, None, None, 1, 1, "e", "t", 1.0, at(1)), ("h2", "r", None, None, None, 1, 1, "e", "t", 1.0, at(5)), ("h3", "r", None, None, None, 9, 1, "e", "t", 1.0, at(7))]
    config = spark.createDataFrame(rows, CORPUS_CONFIG)
    records = spark.createDataFrame([("0", datetime(2019, 1, 1, tzinfo=timezone.utc)), ("1", at(1)), ("2", at(4)), ("3", at(6)), ("4", at(9))], "pmid string, ingested_at timestamp")
    want = {"0": None, "1": "h1", "2": "h1", "3": "h2", "4": "h3"}
    assert {r.pmid: r.config_hash for r in corpus.definition_of(records, config).collect()} == want
    monkeypatch.setattr(corpus, "DAY_ROWS", 1)  # several lines for a day
    assert {r.pmid: r.config_hash for r in corpus.definition_of(records, config).collect()} == want
    # any number of definitions, as a plain search finds them
    for n in (0, 1, 400, 3000):
        times = sorted(datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=37 * (k % 1777), seconds=k // 1777) for k in range(n))
        marks = spark.createDataFrame([(t, f"h{k:05d}") for k, t in enumerate(times)], "created_at timestamp, config_hash string")
        asked = [(str(k), datetime(2019, 12, 31, tzinfo=timezone.utc) + timedelta(minutes=53 * k)) for k in range(900)] + [("none", None)]
        found = {r.pmid: r.config_hash for r in corpus.definition_of(spark.createDataFrame(asked, "pmid string, ingested_at timestamp"), marks).collect()}
        assert found == {p: (f"h{k - 1:05d}" if t and (k := bisect_right(times, t)) else None) for p, t in asked}
    assert {(r.query, r.first_used.day) for r in corpus.definitions(config).collect()} == {("q", 1), ("r", 5)}


def test_reports(store):
    jobs.sync(store, FakeClient([record("1", year="1999"), record("2", year="1991"), record("3", year="x", authors=0)]), CONFIG)
    abstract = store.read("abstract")
    assert {(r.decade, r.n) for r in corpus.decade_histogram(abstract).collect()} == {(1990, 2), (None, 1)}
    assert [tuple(r) for r in corpus.author_blocks(abstract).collect()] == [("name0|a", 2, 2)]
    assert corpus.cursor(abstract).first().cursor == date(2020, 1, 5)
    assert jobs.lookup(store, "abstract", ["2"]).count() == 1


def test_search(spark):
    rows = [("1", "Cardiac deaths in epilepsy", "Sudden deaths studied", ["Death, Sudden", "Epilepsy"]), ("2", "Epilepsy", None, []), ("3", "Heart", "a cardiac study of the heart", ["Sudden Epilepsy"])]
    frame = spark.createDataFrame([(p, {"title": t, "abstract_text": a, "mesh_terms": m}) for p, t, a, m in rows], "pmid string, pubmed struct<title:string,abstract_text:string,mesh_terms:array<string>>")
    index = search.inverted(frame)

    def find(text, config="english"):
        return {r.pmid: r["rank"] for r in search.search(index, search.parse_query(text, config)).collect()}

    assert set(find("epilepsies")) == {"1", "2", "3"} and set(find("deaths cardiac")) == {"1"} and find("epilepsy")["1"] > find("epilepsy")["3"]
    assert set(find('"sudden epilepsy"')) == {"1", "3"}  # over the seam of two headings too
    assert set(find("heart or deaths")) == {"1", "3"} and set(find("epilepsy -sudden")) == {"2"} and find("the") == {} and set(find("the", "simple")) == {"3"}
    apart = search.inverted(frame, "per_term")
    assert {r.pmid for r in search.search(apart, search.phrase_query("sudden epilepsy")).collect()} == {"3"}


def test_page_source(spark):
    spark.dataSource.register(remote.PageSource)
    here = str(Path(__file__).resolve().parent)
    spark.sparkContext.addPyFile(f"{here}/fakes.py")
    config = json.dumps({"query": "q", "ncbi_email": "e", "ncbi_tool": "t", "rate_limit": 0})
    read = spark.read.format("corpus_pages").option("config", config).option("client", "fakes:client_of").option("batch_size", "3")
    rows = read.option("term", "q").load()
    assert rows.rdd.getNumPartitions() == 1
    from foliant.functions.records import read_records

    assert [r.pubmed.pmid for r in read_records(rows).orderBy("batch_id", "seq").collect()] == [str(k) for k in range(1, 8)]
    assert read.option("term", "q").option("max_records", "4").load().count() == 2
    assert [r.pubmed.pmid for r in read_records(read.option("ids", "2,3").load()).collect()] == ["2", "3"]


def test_sync_by_source(store):
    store.spark.sparkContext.addPyFile(f"{Path(__file__).resolve().parent}/fakes.py")
    assert jobs.sync_by_source(store, CONFIG, client="fakes:client_of") == 7
    assert pmids(store.read("abstract")) == [str(k) for k in range(1, 8)] and store.landed().count() == 4 and store.read("corpus_config").count() == 1
    capped = IngestConfig("q", "a@b.c", "t", rate_limit=0, batch_size=2, max_records=3)
    assert jobs.sync_by_source(store, capped, client="fakes:client_of") == 3


def test_sync_by_source_in_parts(store, spark):
    searches = spark.createDataFrame([(f"{k:03d}", ",".join(f"{n}=title {n}" for n in range(10 * k, 10 * k + 10))) for k in range(20)], "number string, query string")
    assert jobs.sync_by_source(store, CONFIG, "x", "foliant.sources.mirror:listed", searches) == 200
    assert {r.pmid: r.title for r in store.read("abstract").select("pmid", "pubmed.title").collect()} == {str(n): f"title {n}" for n in range(200)}
    assert store.landed().count() == 100 and len(store.landed().inputFiles()) > 1 and store.read("corpus_config").count() == 1
    with pytest.raises(ValueError):
        jobs.sync_by_source(store, IngestConfig("q", "a@b.c", "t", max_records=3), searches=searches)


def test_client_paces_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    gate = remote.Gate()
    throttles = [remote.Throttle(2, lambda: now[0], sleep, gate) for _ in range(2)]
    for k in range(3):
        throttles[k % 2].wait()
    assert slept == [0.5, 0.5]
    calls, waits = [], []

    def down():
        calls.append(1)
        raise OSError("x")

    with pytest.raises(OSError):
        remote.retried(down, sleep=waits.append)
    assert len(calls) == 5 and waits == [2, 4, 8, 16]
    with pytest.raises(ValueError):
        remote.retried(lambda: int("x"), sleep=waits.append)
    seen = []

    def answer(url, body):
        seen.append((url, body.decode()))
        if "elink" in url:
            return b"<r><LinkSetDb><Link><Id> </Id></Link><Link><Id>77</Id></Link></LinkSetDb></r>"
        return b"<r><Count>3</Count><WebEnv>w</WebEnv><QueryKey>1</QueryKey></r>"

    client = remote.HttpClient(CONFIG, opener=answer)
    assert client.search_history("q").count == 3 and client.count("q") == 3 and client.elink_pmcid("1") == "PMC77"
    client.fetch_pmc(["PMC1", "pmc2", "3"])
    assert "id=1%2C2%2C3" in seen[-1][1] and "email=a%40b.c" in seen[-1][1]
    assert remote.offsets(5, 2) == [(0, 2), (2, 2), (4, 1)]


def test_stream(store, tmp_path):
    jobs._land(store, "a-000000", 0, "pubmed", fakes.batch(record("1"), record("2")))
    ingest(store, f"{tmp_path}/check").awaitTermination()
    assert pmids(store.read("abstract")) == ["1", "2"]
    jobs._land(store, "b-000000", 0, "pubmed", fakes.batch(record("2", "Newer"), record("3")))
    ingest(store, f"{tmp_path}/check").awaitTermination()
    rows = {r.pmid: r.pubmed.title for r in store.read("abstract").collect()}
    assert rows == {"1": "A study", "2": "Newer", "3": "A study"}
