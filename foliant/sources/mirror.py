"""The remote index's calls, answered from records that are held locally."""

from __future__ import annotations

from collections.abc import Mapping
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.ids import pmc_bare
from foliant.plans.config import IngestConfig
from foliant.sources.remote import SearchResult, bare

RECORD = "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><Journal><Title>J Mirror.</Title></Journal><ArticleTitle>{1}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
ARTICLE = "<article><front><article-meta><article-id pub-id-type='pmid'>{0}</article-id><article-id pub-id-type='pmc'>PMC{0}</article-id></article-meta></front><body><sec><title>Discussion</title><p>{1}</p></sec></body></article>"


RECORD_SET = ("<PubmedArticleSet>", "</PubmedArticleSet>")
ARTICLE_SET = ("<pmc-articleset xmlns:xlink='http://www.w3.org/1999/xlink'>", "</pmc-articleset>")


class Mirror:
    """A client over records and articles in XML, by record number and by bare article number.

    A search finds all records, in their order; what isn't held is left out of an answer.
    """

    def __init__(self, records: Mapping[str, str], articles: Mapping[str, str] | None = None, links: Mapping[str, str] | None = None):
        self.records, self.articles, self.links = dict(records), dict(articles or {}), dict(links or {})
        self.order = [*self.records]

    def search_history(self, term: str) -> SearchResult:
        return SearchResult(len(self.records), "mirror", "1", term)

    def count(self, term: str) -> int:
        return len(self.records)

    def fetch_batch(self, webenv: str, query_key: str, retstart: int, retmax: int) -> bytes:
        return self._set(self.order[retstart : retstart + retmax])

    def fetch_pmids(self, pmids: list[str]) -> bytes:
        return self._set(pmids)

    def fetch_pmc(self, pmcids: list[str]) -> bytes:
        found = (self.articles.get(bare(i), "") for i in pmcids)
        return "".join((ARTICLE_SET[0], *found, ARTICLE_SET[1])).encode()

    def elink_pmcid(self, pmid: str) -> str | None:
        return self.links.get(pmid)

    def _set(self, pmids: list[str]) -> bytes:
        return "".join((RECORD_SET[0], *(self.records.get(p, "") for p in pmids), RECORD_SET[1])).encode()


class Tables:
    """A client over tables: records (pmid, xml), articles (id: the bare number, xml) and links (pmid, pmc_id).

    A search finds all records, in the order of their numbers.  A single call is a look-up of its
    own; the calls of a job (remote.Bulk) are answered together, on the executors.
    """

    def __init__(self, records: DataFrame, articles: DataFrame, links: DataFrame):
        self.records, self.found, self.linked = records, articles, links

    def search_history(self, term: str) -> SearchResult:
        return SearchResult(self.count(term), "tables", "1", term)

    def count(self, term: str) -> int:
        return self.records.count()

    def fetch_batch(self, webenv: str, query_key: str, retstart: int, retmax: int) -> bytes:
        return self._set(self.records.orderBy("pmid").offset(retstart).limit(retmax), RECORD_SET)

    def fetch_pmids(self, pmids: list[str]) -> bytes:
        return self._set(self.records.where(F.col("pmid").isin(pmids)), RECORD_SET)

    def fetch_pmc(self, pmcids: list[str]) -> bytes:
        return self._set(self.found.where(F.col("id").isin([*map(bare, pmcids)])), ARTICLE_SET)

    def elink_pmcid(self, pmid: str) -> str | None:
        return next((r.pmc_id for r in self.linked.where(F.col("pmid") == pmid).limit(1).collect()), None)

    def _set(self, rows: DataFrame, ends: tuple[str, str]) -> bytes:
        return "".join((ends[0], *(r.xml for r in rows.collect()), ends[1])).encode()

    def pages(self, found: SearchResult, total: int, size: int) -> DataFrame:
        rows = self.records if total >= found.count else self.records.orderBy("pmid").limit(total)
        return self._pages(_cut(rows, size), RECORD_SET)

    def articles(self, asked: DataFrame, size: int) -> DataFrame:
        asked = _cut(asked.select(pmc_bare(F.col("pmc_id")).alias("id")), size)
        return self._pages(asked.join(self.found, "id"), ARTICLE_SET)

    def links(self, pmids: DataFrame) -> DataFrame:
        return pmids.join(self.linked, "pmid").select("pmid", "pmc_id")

    @staticmethod
    def _pages(rows: DataFrame, ends: tuple[str, str]) -> DataFrame:
        xml = F.transform(F.array_sort(F.collect_list(F.struct("at", "xml"))), lambda r: r["xml"])
        pages = rows.groupBy("part", "seq").agg(F.concat(F.lit(ends[0]), F.array_join(xml, ""), F.lit(ends[1])).cast("binary").alias("payload"))
        return pages.select(F.format_string("%06d%09d", "part", "seq").alias("number"), "seq", "payload")


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """Rows with their page: each partition is cut by itself, so that nothing has to be counted or put in order."""
    return rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).withColumn("seq", _page(F.col("at"), size))


def _page(at: Column, size: int) -> Column:
    return F.floor(at.bitwiseAND((1 << 33) - 1) / size).cast("int")


def listed(config: IngestConfig) -> Mirror:
    """A mirror of the records that the query lists, number=title with commas between, each with an
    article of that text; the client that the page source or a scan makes of such a config."""
    pairs = [x.partition("=")[::2] for x in config.query.split(",")]
    return Mirror({p: RECORD.format(p, escape(t)) for p, t in pairs}, {p: ARTICLE.format(p, escape(t)) for p, t in pairs}, {p: f"PMC{p}" for p, _ in pairs})
