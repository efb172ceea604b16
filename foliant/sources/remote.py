"""The remote index: a client, its pacing, a Spark data source of its pages, and scans of many searches."""

from __future__ import annotations

import json
import threading
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import islice
from typing import Protocol, runtime_checkable
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.plans.config import IngestConfig, build_query

BASE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
PAGES = "batch_id string, seq int, kind string, payload binary, landed_at timestamp"
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 2.0, 60.0


@dataclass(frozen=True)
class SearchResult:
    count: int
    webenv: str
    query_key: str
    query: str


class Client(Protocol):
    def search_history(self, term: str) -> SearchResult: ...
    def count(self, term: str) -> int: ...
    def fetch_batch(self, webenv: str, query_key: str, retstart: int, retmax: int) -> bytes: ...
    def fetch_pmids(self, pmids: list[str]) -> bytes: ...
    def fetch_pmc(self, pmcids: list[str]) -> bytes: ...
    def elink_pmcid(self, pmid: str) -> str | None: ...


@runtime_checkable
class Bulk(Protocol):
    """What a client has besides, if it answers all requests of a job at once and needs no pacing.

    Answers are frames of number (digits, another for each page), seq and payload; links are pmid and pmc_id.
    """

    def pages(self, found: SearchResult, total: int, size: int) -> DataFrame: ...
    def articles(self, asked: DataFrame, size: int) -> DataFrame: ...
    def links(self, pmids: DataFrame) -> DataFrame: ...


class Gate:
    """When the next request may go; shared by all throttles of a process unless they have their own."""

    def __init__(self) -> None:
        self.lock, self.next = threading.Lock(), 0.0


_GATE = Gate()


class Throttle:
    """At most `rate` passes a second through its gate; 0 lets all pass."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, gate: Gate | None = None):
        self.rate, self.clock, self.sleep, self.gate = rate, clock, sleep, gate or _GATE

    def wait(self) -> None:
        if self.rate <= 0:
            return
        with self.gate.lock:  # held while waiting, so that others queue up behind
            now = self.clock()
            if now < self.gate.next:
                self.sleep(self.gate.next - now)
            self.gate.next = max(now, self.gate.next) + 1 / self.rate


def retried(call: Callable[[], bytes], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Repeat after network errors, waiting twice as long each time; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except OSError:
            if k == attempts - 1:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**k))
    raise AssertionError


def bare(pmcid: str) -> str:
    return pmcid[3:] if pmcid[:3].upper() == "PMC" else pmcid


class HttpClient:
    """The public web service."""

    def __init__(self, config: IngestConfig, throttle: Throttle | None = None, opener: Callable[[str, bytes], bytes] | None = None):
        self.config, self.throttle = config, throttle or Throttle(config.rate_limit)
        self.opener = opener or self._open

    @staticmethod
    def _open(url: str, body: bytes) -> bytes:
        with urllib.request.urlopen(url, body, timeout=120) as r:
            return r.read()

    def _call(self, name: str, **values) -> bytes:
        values |= {"email": self.config.ncbi_email, "tool": self.config.ncbi_tool} | ({"api_key": self.config.ncbi_api_key} if self.config.ncbi_api_key else {})

        def once() -> bytes:
            self.throttle.wait()
            return self.opener(f"{BASE}{name}.fcgi", urllib.parse.urlencode(values).encode())

        return retried(once)

    def search_history(self, term: str) -> SearchResult:
        root = ET.fromstring(self._call("esearch", db="pubmed", term=term, usehistory="y", retmax=0))
        return SearchResult(int(root.findtext("Count")), root.findtext("WebEnv"), root.findtext("QueryKey"), term)

    def count(self, term: str) -> int:
        return int(ET.fromstring(self._call("esearch", db="pubmed", term=term, retmax=0)).findtext("Count"))

    def fetch_batch(self, webenv: str, query_key: str, retstart: int, retmax: int) -> bytes:
        return self._call("efetch", db="pubmed", WebEnv=webenv, query_key=query_key, retstart=retstart, retmax=retmax, retmode="xml")

    def fetch_pmids(self, pmids: list[str]) -> bytes:
        return self._call("efetch", db="pubmed", id=",".join(pmids), retmode="xml")

    def fetch_pmc(self, pmcids: list[str]) -> bytes:
        return self._call("efetch", db="pmc", id=",".join(map(bare, pmcids)), retmode="xml")

    def elink_pmcid(self, pmid: str) -> str | None:
        root = ET.fromstring(self._call("elink", dbfrom="pubmed", db="pmc", id=pmid))
        found = (e.text.strip() for e in root.iterfind(".//LinkSetDb/Link/Id") if e.text and e.text.strip())
        return next((f"PMC{i}" for i in found), None)


def offsets(total: int, size: int) -> list[tuple[int, int]]:
    """(offset, take) of each page."""
    return [(k, min(size, total - k)) for k in range(0, total, size)]


def _id_calls(kind: str, ids: list[str], size: int) -> list[tuple[str, tuple]]:
    return [("fetch_pmc" if kind == "pmc" else "fetch_pmids", (ids[a : a + n],)) for a, n in offsets(len(ids), size)]


def _search_calls(client: Client, term: str, size: int, most: str | None = None) -> list[tuple[str, tuple]]:
    found = client.search_history(term)
    total = min(found.count, int(most)) if most else found.count
    return [("fetch_batch", (found.webenv, found.query_key, a, n)) for a, n in offsets(total, size)]


class Page(InputPartition):
    def __init__(self, batch_id: str, calls: list[tuple[str, tuple]]):
        self.batch_id, self.calls = batch_id, calls


class PageReader(DataSourceReader):
    """Pages one after the other in one partition: the service counts requests by caller, so more
    readers would only have to share the same pace."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o, size = self.options, int(self.options.get("batch_size", 200))
        if "ids" in o:
            calls = _id_calls(o.get("kind", "pubmed"), [i for i in o["ids"].split(",") if i], size)
        else:
            calls = _search_calls(make_client(o), o["term"], size, o.get("max_records"))
        return [Page(o.get("batch_id", "batch"), calls)]

    def read(self, partition: Page) -> Iterator[tuple]:
        client = make_client(self.options)
        for k, (name, values) in enumerate(partition.calls):
            yield f"{partition.batch_id}-{k:06d}", k, self.options.get("kind", "pubmed"), getattr(client, name)(*values), datetime.now(timezone.utc)


class PageSource(DataSource):
    """format("corpus_pages") with term or ids, kind, batch_size, max_records, config (JSON of an
    IngestConfig) and client (module:function, that makes a client of it)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def make_client(options: dict) -> Client:
    config = IngestConfig(**json.loads(options["config"]))
    if "client" in options:
        import importlib

        module, _, name = options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(config)
    return HttpClient(config)


def each(searches: DataFrame, config: IngestConfig, client: str | None, answer: Callable[[Client, dict], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """Rows that clients answer to searches, each search in one task by a client of its own.

    A search is a row with the query to put in the config's place, and whatever answer(client, row)
    reads of it.  Tasks run side by side if the config has no rate to keep, else all is one task's.
    """
    given, n = config.recorded(), 4 * searches.sparkSession.sparkContext.defaultParallelism
    columns = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                made = make_client({"config": json.dumps(given | {"query": row["query"]})} | ({"client": client} if client else {}))
                for rows in answer(made, row):
                    yield pd.DataFrame(rows, columns=columns)

    return (searches.coalesce(1) if config.rate_limit else searches.repartition(n)).mapInPandas(run, schema)


def scan(searches: DataFrame, config: IngestConfig, client: str | None = None, term: str | None = None, kind: str = "pubmed", batch_id: str = "batch") -> DataFrame:
    """The pages of searches (number: digits, another for each, query), by the term or else the query's own.

    With a column ids those are fetched instead, as articles if kind is pmc.
    """

    def answer(made: Client, row: dict) -> Iterator[list[tuple]]:
        own = IngestConfig(**config.recorded() | {"query": row["query"]})
        ids = row.get("ids")
        calls = _search_calls(made, term or build_query(own), own.batch_size) if ids is None else _id_calls(kind, [*ids], own.batch_size)
        for k, (name, values) in enumerate(calls):
            yield [(f"{batch_id}-{row['number']}{k:06d}", k, kind, getattr(made, name)(*values), datetime.now(timezone.utc))]

    return each(searches, config, client, answer, PAGES)


def batches(ids: Iterable, size: int) -> Iterator[list]:
    ids = iter(ids)
    while part := list(islice(ids, size)):
        yield part
