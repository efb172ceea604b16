"""Jobs over a store: sync, full-text fetch, reparse, snapshots and seeding.

Each job lands what it reads first, page by page, and then changes the tables once, by joins
over all that was landed, whatever the number of pages.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.citation import reference
from foliant.functions.records import citation_records, parse_record, read_articles, read_records
from foliant.functions.supplied import DEFAULT, SeedError, SeedProfile
from foliant.operators import corpus
from foliant.plans.config import IngestConfig, build_query, incremental_term
from foliant.schemas import CORPUS_CONFIG, FULLTEXT, LANDING, OWNERS
from foliant.sources import snapshot
from foliant.sources.remote import Bulk, Client, PageSource, batches, offsets, scan
from foliant.sources.tables import Store

log = logging.getLogger(__name__)


def _new_record() -> dict:
    return {"fetch_failed": F.lit(False), "ingested_at": F.current_timestamp()}


#: Pages and bytes that are landed together.
LAND_PAGES, LAND_BYTES = 32, 32 << 20
#: Ids that are looked up before they are noted.
LINKS = 2000


def _land(store: Store, batch_id: str, seq: int, kind: str, payload: bytes) -> None:
    _land_all(store, [(batch_id, seq, kind, bytearray(payload), datetime.now(timezone.utc))])


def _land_all(store: Store, rows: list[tuple]) -> None:
    if rows:
        store.land(store.spark.createDataFrame(rows, LANDING).coalesce(1))


class _Landing:
    """Pages on their way to the store, some at a time; on the way out of the block all are landed."""

    def __init__(self, store: Store, kind: str):
        self.store, self.kind, self.rows, self.pages, self.bytes = store, kind, [], 0, 0

    def __enter__(self) -> _Landing:
        return self

    def add(self, batch_id: str, seq: int, payload: bytes) -> None:
        self._add(batch_id, seq, self.kind, payload)
        self.pages += 1
        if self.pages >= LAND_PAGES or self.bytes >= LAND_BYTES:
            self.flush()

    def note(self, batch_id: str, seq: int, kind: str, rows: list[dict]) -> None:
        """What belongs to a page, to be read by _noted."""
        self._add(batch_id, seq, kind, json.dumps(rows).encode())

    def _add(self, batch_id: str, seq: int, kind: str, payload: bytes) -> None:
        self.rows.append((batch_id, seq, kind, bytearray(payload), datetime.now(timezone.utc)))
        self.bytes += len(payload)

    def flush(self) -> None:
        _land_all(self.store, self.rows)
        self.rows, self.pages, self.bytes = [], 0, 0

    def __exit__(self, *_: object) -> None:
        self.flush()


def _noted(store: Store, run: str, kind: str) -> DataFrame:
    """The records that a run's notes of a kind are about: pmid, pmc_id, batch_failed."""
    rows = F.from_json(F.col("payload").cast("string"), "array<struct<pmid:string,pmc_id:string,batch_failed:boolean>>")
    return store.landed(run).where(F.col("kind") == kind).select(F.inline(rows))


def _land_pages(store: Store, run: str, kind: str, pages: DataFrame) -> None:
    """Land a bulk client's answers, in one job."""
    store.land(pages.select(F.concat(F.lit(f"{run}-"), "number").alias("batch_id"), "seq", F.lit(kind).alias("kind"), "payload", F.current_timestamp().alias("landed_at")))


def _new_run() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def record_definition(store: Store, config: IngestConfig) -> str:
    """Write down the settings before anything is fetched; those known keep their first time."""
    r = config.recorded()
    row = (config.config_hash(), r["query"], r["year_min"], r["year_max"], r["max_records"], r["batch_size"], r["pmc_batch_size"], r["ncbi_email"], r["ncbi_tool"], float(r["rate_limit"]), datetime.now(timezone.utc))
    known = store.read("corpus_config")
    if known.where(F.col("config_hash") == row[0]).limit(1).count() == 0:
        store.write("corpus_config", corpus.insert_if_absent(known, store.spark.createDataFrame([row], CORPUS_CONFIG), "config_hash"))
    return row[0]


def merge_records(store: Store, landing: DataFrame) -> int:
    """Put the citation records of landed batches into the store; how many were read.

    Of a record read twice the last one counts.  Citations of held papers follow their record.
    """
    values = corpus.abstract_values(read_records(landing)).persist()  # parsed once
    try:
        new = corpus.last_wins(values, "pmid", "batch_id", "seq")
        n = values.count()
        if n:
            records = corpus.merge_upsert(store.read("abstract"), new, "pmid", OWNERS["sync"], _new_record())
            store.commit({"abstract": records, "paper": corpus.recited(store.read("paper"), new.select("pmid", "pubmed"))})
    finally:
        values.unpersist()
    return n


def sync(
    store: Store, client: Client, config: IngestConfig, since: date | None = None, days_back: int = 3, batch_size: int | None = None, full: bool = False, today: date | None = None,
) -> int:
    """Bring the records up to date; how many were read.

    All of the corpus if asked to or if there is none yet; else what was entered since the given
    day, or since some days before the latest entry held.  Years and the cap on records count
    for a whole pull only.  A failure leaves the pages read so far landed and merged; a bulk client's
    pages are landed in one job, and a failure lands none of them.
    """
    record_definition(store, config)
    if not full and since is None:
        latest = corpus.cursor(store.read("abstract")).first()["cursor"]
        since = latest - timedelta(days=days_back) if latest else None
    whole = full or since is None
    term = build_query(config) if whole else incremental_term(config, since, today or date.today())
    found = client.search_history(term)
    total = min(found.count, config.max_records) if whole and config.max_records else found.count
    run = _new_run()
    failure, size = None, batch_size or config.batch_size
    if total and isinstance(client, Bulk):
        _land_pages(store, run, "pubmed", client.pages(found, total, size))
        return merge_records(store, store.landed(run))
    with _Landing(store, "pubmed") as landing:
        for k, (start, take) in enumerate(offsets(total, size)):
            try:
                page = client.fetch_batch(found.webenv, found.query_key, start, take)
            except Exception as error:  # noqa: BLE001  what was read before is landed and merged, then it goes on up
                log.exception("sync stopped at record %d of %d", start, total)
                failure = error
                break
            landing.add(f"{run}-{k:06d}", k, page)
    n = merge_records(store, store.landed(run)) if total else 0
    if failure:
        raise failure
    return n


def sync_by_source(store: Store, config: IngestConfig, term: str | None = None, client: str | None = None, searches: DataFrame | None = None) -> int:
    """A whole pull with the pages read and landed by Spark, in one job; how many records were read.

    client: module:function that makes a client of the config, instead of the public service's.
    searches: the definition in parts (see remote.scan), which are read side by side if there is no
    rate to keep; without them one task reads all pages.  As the pages are one job's, a failure
    lands none of them.  The service's key isn't sent along.
    """
    if searches is not None and config.max_records:
        raise ValueError("a cap on records holds for one search, not for parts of it")
    record_definition(store, config)
    run = _new_run()
    if searches is not None:
        store.land(scan(searches, config, client, term, batch_id=run))
        return merge_records(store, store.landed(run))
    store.spark.dataSource.register(PageSource)
    options = {"config": json.dumps(config.recorded()), "term": term or build_query(config), "batch_size": str(config.batch_size), "batch_id": run}
    options |= {k: v for k, v in (("client", client), ("max_records", config.max_records and str(config.max_records))) if v}
    store.land(store.spark.read.format(PageSource.name()).options(**options).load())
    return merge_records(store, store.landed(run))


def _relinked(store: Store, client: Client, queue: DataFrame, run: str) -> DataFrame:
    """The queue, in its order, with ids looked up for records that have none."""
    missing = queue.where(F.coalesce(F.col("pmc_id"), F.lit("")) == "").select("pmid")
    if isinstance(client, Bulk):
        links = client.links(missing)
    else:
        with _Landing(store, "link") as landing:
            for k, part in enumerate(batches((r.pmid for r in missing.toLocalIterator()), LINKS)):
                landing.note(f"{run}-{k:06d}", k, "link", [{"pmid": p, "pmc_id": client.elink_pmcid(p)} for p in part])
                landing.flush()
        links = _noted(store, run, "link")
    found = queue.join(links.select("pmid", F.col("pmc_id").alias("_linked")), "pmid", "left")
    found = found.select("pmid", F.coalesce(F.nullif("pmc_id", F.lit("")), "_linked").alias("pmc_id"), "pub_year")
    return found.orderBy(F.col("pub_year").desc_nulls_last(), "pmid")


def _walk(store: Store, client: Client, queue: DataFrame, run: str, size: int) -> BaseException | None:
    """Fetch the articles of the queue, batch by batch by a client that may send one request at a time.

    What was asked is noted beside the answers, so that no more than some batches are held here; an
    interrupt ends the walk and is returned.
    """
    with _Landing(store, "pmc") as landing:
        for k, part in enumerate(batches(queue.toLocalIterator(), size)):
            failed = False
            try:
                landing.add(f"{run}-{k:06d}", k, client.fetch_pmc([r.pmc_id for r in part]))
            except Exception:  # noqa: BLE001  a batch that fails, for whatever reason, costs itself only
                log.exception("batch %d failed", k)
                failed = True
            except BaseException as error:  # noqa: BLE001  an interrupt: what is settled is kept, and it goes on up
                return error
            landing.note(f"{run}-{k:06d}", k, "asked", [r.asDict() | {"batch_failed": failed} for r in part])
    return None


def fetch_fulltext(
    store: Store, client: Client, config: IngestConfig, pmids: list[str] | None = None, limit: int | None = None, batch_size: int | None = None,
    retry: bool = False, recheck: bool = False, relink: bool = False,
) -> dict[str, int]:
    """Fetch articles of the queue and settle each record; how many came to each outcome."""
    abstract, paper = store.read("abstract"), store.read("paper")
    queue = corpus.candidates(abstract, paper, pmids, retry, recheck, limit).select("pmid", "pmc_id", "pub_year")
    if queue.isEmpty():
        return {}
    run, size, failure = _new_run(), batch_size or config.pmc_batch_size, None
    if relink:
        queue = _relinked(store, client, queue, run)
    has_id = F.coalesce(F.col("pmc_id"), F.lit("")) != ""
    asked = queue.select("pmid", "pmc_id", F.lit(False).alias("batch_failed"))
    if isinstance(client, Bulk):
        _land_pages(store, run, "pmc", client.articles(asked.where(has_id), size))
    else:
        failure = _walk(store, client, queue.where(has_id).select("pmid", "pmc_id"), run, size)
        asked = asked.where(~has_id).unionByName(_noted(store, run, "asked"))
    # XML packs well: a table that is small on disk may be too large to be sent to all
    stored = asked.join(abstract.select("pmid", "pubmed_xml").hint("merge"), "pmid")
    matched = corpus.match_articles(stored, read_articles(store.landed(run)))
    # without an article the record isn't needed
    matched = matched.withColumn("pubmed", parse_record(F.when(F.col("article").isNotNull(), F.col("pubmed_xml"))))
    settled = corpus.outcomes(matched, paper).select("pmid", "pmc_id", "outcome", "fulltext", "jats_xml", "citation").persist()
    try:
        out = {r.outcome: r.n for r in corpus.tally(settled).collect()}
        papers = corpus.merge_upsert(paper, settled.where("outcome = 'ok'"), "pmid", OWNERS["fetch"], touch=None)
        state = settled.select("pmid", (F.col("outcome") != "ok").alias("fetch_failed"), "pmc_id")
        update = ["fetch_failed", "pmc_id"] if relink else ["fetch_failed"]
        store.commit({"paper": papers, "abstract": corpus.merge_upsert(abstract, state, "pmid", update)})
    finally:
        settled.unpersist()
    if failure:
        raise failure
    return out


def reparse(store: Store) -> int:
    """Derive all columns and citations anew from the stored XML; how many could be read."""
    records = store.read("abstract").select("pubmed_xml", parse_record(F.col("pubmed_xml")).alias("pubmed")).where("pubmed is not null")
    values = corpus.abstract_values(records).dropDuplicates(["pmid"]).persist()
    try:
        n = values.count()
        records = corpus.merge_upsert(store.read("abstract"), values, "pmid", OWNERS["reparse"])
        store.commit({"abstract": records, "paper": corpus.recited(store.read("paper"), values.select("pmid", "pubmed"))})
    finally:
        values.unpersist()
    return n


def export_snapshot(store: Store, path: str) -> int:
    return snapshot.export(store.read("abstract"), store.read("paper"), path)


def import_snapshot(store: Store, path: str | list[str], batch_files: bool = False) -> int:
    """Put a snapshot's records into the store; how many there were.

    As a whole, so that a bad line changes nothing; with batch_files one file after the other.
    """
    if batch_files:
        files = store.spark.read.text(path).inputFiles()
        return sum(import_snapshot(store, f) for f in sorted(files))
    decoded = snapshot.read(store.spark, path)
    n = decoded.where("pmid is not null").count()
    if n:
        numbered = decoded.withColumn("_seq", F.monotonically_increasing_id())
        rows = corpus.last_wins(numbered, "pmid", "_seq")
        records = corpus.merge_upsert(store.read("abstract"), rows, "pmid", OWNERS["snapshot"], _new_record())
        held = rows.where("paper is not null").select("paper.*")
        store.commit({"abstract": records, "paper": corpus.merge_upsert(store.read("paper"), held, "pmid", OWNERS["fetch"], touch=None)})
    return n


def seed_paper(store: Store, pmid: str, payload: dict, profile: SeedProfile = DEFAULT) -> None:
    """Take a text supplied by hand as the paper of a known record, and forget failures to fetch it."""
    row = store.read("abstract").where(F.col("pmid") == pmid).select("pubmed_xml").first()
    if row is None:
        raise SeedError(f"pmid {pmid} has no record here; sync first, or it isn't part of the corpus")
    if not payload.get("sections"):
        raise SeedError(f"pmid {pmid}: payload has no sections")
    if not citation_records(row.pubmed_xml):
        raise SeedError(f"pmid {pmid}: the stored record can't be read, so it can't be cited")
    full = {k: payload.get(k) for k in FULLTEXT.fieldNames()}
    new = store.spark.createDataFrame([(pmid, full)], f"pmid string, fulltext {FULLTEXT.simpleString()}")
    stored = store.read("abstract").where(F.col("pmid") == pmid).select("pmid", reference(parse_record(F.col("pubmed_xml"))).alias("citation"))
    rows = new.join(stored, "pmid").withColumn("jats_xml", F.lit(profile.seeded_jats))
    papers = corpus.merge_upsert(store.read("paper"), rows, "pmid", OWNERS["fetch"], touch=None)
    state = new.select("pmid", F.lit(False).alias("fetch_failed"))
    store.commit({"paper": papers, "abstract": corpus.merge_upsert(store.read("abstract"), state, "pmid", ["fetch_failed"])})
    log.warning("pmid %s: seeded by hand (%d sections)", pmid, len(payload["sections"]))


def lookup(store: Store, name: str, pmids: Iterable[str]) -> DataFrame:
    """Rows by key; the filter reaches the Parquet scan."""
    return store.read(name).where(F.col("pmid").isin(list(pmids)))
