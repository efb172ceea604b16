"""Made-up records and a client that serves them."""

from foliant.sources.remote import SearchResult


def record(pmid, title="A study", entrez=("2020", "1", "5"), extra="", pmc=None, types=("Journal Article",), year="2019", authors=1):
    people = "".join(f"<Author><LastName>Name{k}</LastName><ForeName>Ada {chr(65 + k)}.</ForeName><Initials>A{chr(65 + k)}</Initials></Author>" for k in range(authors))
    history = f"<History><PubMedPubDate PubStatus='entrez'><Year>{entrez[0]}</Year><Month>{entrez[1]}</Month><Day>{entrez[2]}</Day></PubMedPubDate></History>" if entrez else ""
    ids = f"<ArticleIdList><ArticleId IdType='pubmed'>{pmid}</ArticleId>" + (f"<ArticleId IdType='pmc'>{pmc}</ArticleId>" if pmc else "") + "</ArticleIdList>"
    kinds = "".join(f"<PublicationType>{t}</PublicationType>" for t in types)
    return (
        f"<PubmedArticle><MedlineCitation><PMID Version='1'>{pmid}</PMID><Article><Journal><JournalIssue><Volume>3</Volume><Issue>2</Issue><PubDate><Year>{year}</Year>"
        f"<Month>Mar</Month><Day>7</Day></PubDate></JournalIssue><Title>J Tests.</Title></Journal><ArticleTitle>{title}</ArticleTitle>{extra}"
        f"<Pagination><MedlinePgn>10-9</MedlinePgn></Pagination><AuthorList>{people}</AuthorList><PublicationTypeList>{kinds}</PublicationTypeList></Article></MedlineCitation>"
        f"<PubmedData>{history}{ids}</PubmedData></PubmedArticle>"
    )


def batch(*records):
    return ("<?xml version='1.0'?><PubmedArticleSet>" + "".join(records) + "</PubmedArticleSet>").encode()


def article(pmid, pmcid, body="<sec><title>Discussion</title><p>Said.</p></sec>", license_="<license xlink:href='https://creativecommons.org/licenses/by-nc/4.0/'/>"):
    return (
        f"<article><front><article-meta><article-id pub-id-type='pmid'>{pmid}</article-id><article-id pub-id-type='pmc'>{pmcid}</article-id>"
        f"<title-group><article-title>T {pmid}</article-title></title-group><permissions>{license_}</permissions></article-meta></front><body>{body}</body></article>"
    )


def articles(*found):
    return ("<pmc-articleset xmlns:xlink='http://www.w3.org/1999/xlink'>" + "".join(found) + "</pmc-articleset>").encode()


class FakeClient:
    def __init__(self, records=(), full=None, fail_at=None, links=None):
        self.records, self.full, self.fail_at, self.links = list(records), full or {}, fail_at, links or {}
        self.terms, self.calls = [], []

    def search_history(self, term):
        self.terms.append(term)
        return SearchResult(len(self.records), "env", "1", term)

    def count(self, term):
        return len(self.records)

    def fetch_batch(self, webenv, query_key, start, take):
        self.calls.append((start, take))
        if self.fail_at is not None and len(self.calls) > self.fail_at:
            raise OSError("down")
        return batch(*self.records[start : start + take])

    def fetch_pmids(self, pmids):
        return batch(*(r for r in self.records if any(f">{p}</PMID>" in r for p in pmids)))

    def fetch_pmc(self, ids):
        self.calls.append(tuple(ids))
        if any(i in ("PMC666",) for i in ids):
            raise OSError("down")
        return articles(*(self.full[i] for i in ids if i in self.full))

    def elink_pmcid(self, pmid):
        return self.links.get(pmid)


def client_of(config):
    return FakeClient([record(str(k)) for k in range(1, 8)])
