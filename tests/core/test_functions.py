import sys
import tracemalloc
from datetime import date
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import fakes
import pytest
from pyspark.sql import functions as F

from foliant.functions import citation, ids, records, sections, stem, supplied, text
from foliant.schemas import AUTHORS


def column(spark, expression, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression.alias("y")).collect()]


def test_text(spark):
    rows = [("  a \n b ",), ("  \t",), ("",), (None,), ("a.",), ("why?",)]
    assert column(spark, text.blank_to_null(F.col("x")), rows) == ["  a \n b ", None, None, None, "a.", "why?"]
    assert column(spark, text.flat(F.col("x")), rows) == ["a \n b", None, None, None, "a.", "why?"]
    assert column(spark, text.collapsed(F.col("x")), rows)[:2] == ["a b", None]
    assert column(spark, text.ensure_period(F.col("x")), rows)[3:] == [None, "a.", "why?"]


ORCIDS = [
    ("0000-0001-2345-6789", "0000-0001-2345-6789"), ("https://orcid.org/0000-0002-1111-222X", "0000-0002-1111-222X"), ("000000021111222x", "0000-0002-1111-222X"),
    ("0000 0001 2345 6789", "0000-0001-2345-6789"), ("12", None), ("", None), (None, None), ("0000-0001-2345-678", None),
]
KEYS = [("Wang", "Jing", None, "wang|j"), (" O'Neil ", None, "AB", "o'neil|a"), ("Solo", None, None, "solo|"), (None, "X", "X", None), ("", "X", None, None)]


def test_ids(spark):
    assert column(spark, ids.orcid(F.col("x")), [(a,) for a, _ in ORCIDS]) == [b for _, b in ORCIDS] == [records.orcid_text(a) for a, _ in ORCIDS]
    got = column(spark, ids.canonical_key(F.col("a"), F.col("b"), F.col("c")), [k[:3] for k in KEYS], "a string, b string, c string")
    assert got == [k[3] for k in KEYS] == [records.key_text(*k[:3]) for k in KEYS]
    assert column(spark, ids.pmc_prefixed(F.col("x")), [("12",), ("pmc12",), (None,)]) == ["PMC12", "pmc12", None]
    assert column(spark, ids.pmc_bare(F.col("x")), [("PMC12",), ("pmc12",), ("12",)]) == ["12"] * 3
    got = column(spark, ids.reference_url(F.col("a"), F.col("b")), [("1", "10.1/x"), (None, " 10.1/x "), (None, " "), (None, None)], "a string, b string")
    assert got == ["https://pubmed.ncbi.nlm.nih.gov/1/", "https://doi.org/10.1/x", None, None]
    assert column(spark, ids.is_retracted(F.col("x")), [(["Retracted Publication "],), (["Retraction of Publication"],), ([],), (None,)], "x array<string>") == [True, False, False, False]


HEADINGS = [
    ("Introduction", "intro"), ("BACKGROUND", "intro"), ("Materials and methods", "methods"), ("Results and discussion", "discussion"), ("Summary and conclusions", "conclusions"),
    ("Key findings", "results"), ("Preferences", "back_matter"), ("Study design", "methods"), ("Final remarks", "conclusions"), ("Case 1", "other"), (None, "other"), ("", "other"),
    ("Conflict of interest", "back_matter"), ("Statistical analysis", "methods"),
]


def test_sections(spark):
    none = F.lit(None).cast("string")
    assert column(spark, sections.classify(none, F.col("x")), [(h,) for h, _ in HEADINGS]) == [k for _, k in HEADINGS] == [sections.classify_text(None, h) for h, _ in HEADINGS]
    assert column(spark, sections.classify(F.lit("methods|results"), F.col("x")), [("Discussion",)]) == ["methods"]
    rows = [([("other", "Discussion", "a"), ("results", "Discussion", "b"), (None, "Aims", ""), ("conclusions", None, "c")],), ([],), (None,)]
    kinds = "x array<struct<type:string,title:string,text:string>>"
    assert column(spark, F.transform("x", sections.effective_type), rows, kinds)[0] == ["discussion", "results", "other", "conclusions"]
    assert column(spark, sections.has_body(F.col("x")), rows, kinds) == [True, False, False]
    assert column(spark, sections.section_text(F.col("x"), "conclusions", "results"), rows, kinds) == ["b\n\nc", None, None]


LICENSES = [
    ("http://creativecommons.org/licenses/by-nc-nd/4.0/", "x", "t", "CC BY-NC-ND"), ("https://creativecommons.org/publicdomain/zero/1.0/", None, None, "CC0"),
    (None, " publisher ", "t", "publisher"), ("", None, "t" * 120, "t" * 100), (None, None, None, None),
]


def test_license(spark):
    got = column(spark, sections.license_label(F.col("a"), F.col("b"), F.col("c")), [x[:3] for x in LICENSES], "a string, b string, c string")
    assert got == [x[3] for x in LICENSES]


def person(position, last=None, fore=None, initials=None, collective=None):
    return (position, False, last, fore, initials, collective, None, None, None)


def test_citation(spark):
    many = [person(k, f"L{k}", f"Ann {k}") for k in range(8, 0, -1)]
    rows = [
        ([person(2, "Doe", None, "J. R."), person(1, "Smith", "Anna Beth")], "T", "J Tests.", 2019, "3", "2", "10-9", "1", "10.1/x"),
        (many, "Why?", None, 2005, None, None, None, "9", None), ([person(1, None, None, None, " Group ")], " ", "", None, None, "4", "5", None, None),
        ([person(1)], None, None, 2001, None, None, "7", "2", " "), (None, None, None, None, None, None, None, None, None),
    ]
    schema = f"authors {AUTHORS.simpleString()}, title string, journal string, pub_year int, volume string, issue string, pages string, pmid string, doi string"
    frame = spark.createDataFrame(rows, schema)
    got = [r[0] for r in frame.select(citation.reference(F.struct("*"))).collect()]
    assert got == [
        "Smith AB, Doe JR. T. J Tests. 2019;3(2):10-9. doi:10.1/x", "L1 A1, L2 A2, L3 A3, L4 A4, L5 A5, L6 A6, et al. Why? 2005. PMID: 9", "Group. (4):5.", "2001;7. PMID: 2", "",
    ]


def test_records():
    extra = "<Abstract><AbstractText Label='AIM'>To <i>see</i>.</AbstractText><AbstractText/><AbstractText NlmCategory='RESULTS'>1·5</AbstractText></Abstract><ELocationID EIdType='doi'>10.1/y</ELocationID>"
    r, s = records.citation_records(fakes.batch(fakes.record("7", "On <i>x</i>: y", extra=extra, pmc="12", authors=2), fakes.record("8", types=("Retracted Publication",), entrez=None, year="x1", authors=0)))
    assert (r["pmid"], r["title"], r["journal"], r["pages"], r["doi"], r["pmc_id"]) == ("7", "On x: y", "J Tests.", "10-9", "10.1/y", "PMC12")
    assert r["abstract_text"] == "AIM: To see.\n\nRESULTS: 1·5" and r["pub_date"] == date(2019, 3, 7) and r["entry_date"] == date(2020, 1, 5)
    assert [(a["position"], a["is_last"], a["canonical_key"]) for a in r["authors"]] == [(1, False, "name0|a"), (2, True, "name1|a")]
    assert s["is_retracted"] and s["pub_year"] is None and s["pub_date_raw"] == "x1 Mar 7" and s["entry_date"] is None and s["authors"] == []
    assert r["raw_xml"].startswith("<PubmedArticle>") and records.citation_records(r["raw_xml"])[0]["title"] == "On x: y"


def test_dates():
    def pub(xml):
        return records.publication_date(records.ET.fromstring(f"<PubDate>{xml}</PubDate>"))

    assert pub("<MedlineDate>1998 Jan-Feb</MedlineDate>") == (None, 1998, "1998 Jan-Feb")
    assert pub("<Year>2001</Year><Month>02</Month><Day>30</Day>") == (None, 2001, "2001 02 30")
    assert pub("<Year>2005</Year>") == (date(2005, 1, 1), 2005, "2005") and pub("<Month>May</Month>") == (None, None, "May")


def test_broken_batches():
    good, bad = fakes.record("1"), "<PubmedArticle><MedlineCitation><PMID>2</PMID></Oops></PubmedArticle>"
    assert [r["pmid"] for r in records.citation_records(fakes.batch(good, bad, fakes.record("3")))] == ["1", "2", "3"]
    assert [r["pmid"] for r in records.citation_records(b"<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID>")] == ["1"]
    assert records.citation_records(b"<PubmedArticleSet/>") == records.citation_records(None) == records.citation_records(b"") == []
    cut = fakes.articles(fakes.article("1", "PMC1"), "<article><front></article>", fakes.article("2", "2"))
    assert [(a["pmid"], a["pmcid"], a["license"]) for a in records.full_texts(cut)] == [("1", "PMC1", "CC BY-NC"), (None, None, None), ("2", "PMC2", "CC BY-NC")]


def test_what_can_be_read_of_a_broken_record_is_kept():
    xml = fakes.batch(fakes.record("1", "A &nbsp;b &amp; c <i>d</b> e"), fakes.record("2"))
    one, two = records.citation_records(xml)
    assert (one["pmid"], one["title"], one["pages"], one["journal"]) == ("1", "A b & c d e", "10-9", "J Tests.") and two["title"] == "A study"
    assert records.citation_records(one["raw_xml"])[0]["title"] == one["title"] and two["raw_xml"] == fakes.record("2")
    whole = fakes.batch(fakes.record("1"), fakes.record("2", "Longer title", authors=2))
    for n in range(60, len(whole)):  # cut off anywhere
        found = records.citation_records(whole[:n])
        assert [r["pmid"] for r in found] in ([], ["1"], ["1", "2"]) and (n < len(fakes.batch(fakes.record("1"))) or found[0]["title"] == "A study")
    (a,) = records.full_texts(fakes.articles(fakes.article("1", "PMC1", "<sec><title>Discussion</title><p>a &undefined; b < c</p><p><![CDATA[x < y]]></p>")))
    assert a["sections"] == [{"type": "discussion", "title": "Discussion", "text": "a b < c\n\nx < y"}] and a["license"] == "CC BY-NC"


def test_large_batches_are_read_record_by_record(monkeypatch):
    odd = ["<article>a<article>b</article> tail</article>\n", "<article/>", "<!-- <article> -->", "<p><article>c</article></p>", "<x:article xmlns:x='u'/>", "<article>&nbsp;</article>", "<article>cut"]
    for n in range(1, len(odd) + 1):
        for xml in (f"<?xml version='1.0'?><r>{''.join(odd[:n])}</r>", "".join(odd[:n])):
            monkeypatch.undo()
            want = [(el.text, raw) for el, raw in records.elements(xml, "article")]
            monkeypatch.setattr(records, "WHOLE", 0)
            for chunk in (1, 5, 1 << 16):
                monkeypatch.setattr(records, "CHUNK", chunk)
                assert [(el.text, raw) for el, raw in records.elements(xml, "article")] == want
    monkeypatch.undo()
    one = fakes.record("1", authors=20)
    for end in (b"", b"<PubmedArticle>"):  # well formed, and not
        xml = fakes.batch(*[one] * 3000) + end
        tracemalloc.start()
        assert sum(r.get("pmid") == "1" for r in records.each_record(xml)) == 3000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 3 * len(xml)


def test_articles():
    body = "<p>loose</p><sec sec-type='intro'><title>One</title><p>a  b</p><sec><title>In</title><p>c</p></sec></sec><sec><title>Outcomes</title></sec>"
    (a,) = records.full_texts(fakes.articles(fakes.article("1", "PMC1", body)))
    assert a["sections"] == [{"type": "intro", "title": "One", "text": "a b\n\nc"}, {"type": "results", "title": "Outcomes", "text": ""}]
    (b,) = records.full_texts(fakes.articles(fakes.article("1", "1", "<p>x</p><p>y</p>", "")))
    assert b["sections"] == [{"type": "other", "title": None, "text": "x\n\ny"}] and b["license"] is None and b["pmcid"] == "PMC1"
    (c,) = records.full_texts(b"<article><front><article-meta/></front></article>")
    assert c["sections"] == [] and c["title"] is None


SUPPLIED = """
  On the off ice of things
A. Author, B. Author

Summary
We looked. It was the pathophysiology.1,3
wrapped here

Introduction
First line
second line

New paragraph
but this finding
Discussion
Done.4
Methods
Summary
Some words at last.
"""


def test_supplied(spark):
    profile = supplied.SeedProfile(ligatures={"off ice": "office"})
    want = supplied.parse_text(SUPPLIED, profile)
    assert want["title"] == "On the office of things" and want["abstract"] == "We looked. It was the pathophysiology. wrapped here"
    assert [(s["type"], s["title"]) for s in want["sections"]] == [("intro", "Introduction"), ("discussion", "Discussion"), ("conclusions", "Summary")]
    assert want["sections"][0]["text"] == "First line second line\n\nNew paragraph but this finding" and want["sections"][1]["text"] == "Done."
    got = spark.createDataFrame([(SUPPLIED,), (None,)], "x string").select(supplied.parse_supplied(F.col("x"), profile)).collect()
    assert got[0][0].asDict(True) == want and got[1][0].sections == []
    lines = SUPPLIED.splitlines()
    assert column(spark, supplied.is_heading(F.col("x")), [(x,) for x in lines]) == [supplied.is_heading_text(x) for x in lines]
    assert column(spark, supplied.clean(F.col("x"), profile), [(x,) for x in lines]) == [supplied.clean_text(x, profile) for x in lines]
    assert supplied.clean_text("in 2013.5 units, years.4–7") == "in 2013.5 units, years."


def test_payload(tmp_path, spark):
    path = tmp_path / "p.json"
    path.write_text('{"title": "T",\n "abstract": null, "sections": [], "license": "x"}')
    assert supplied.load_payload(str(path)) == supplied.load_payload(f"file://{path}", spark) == {"title": "T", "abstract": None, "sections": [], "license": "x"}
    path.write_text('{"title": 1}')
    with pytest.raises(supplied.SeedError, match="abstract, license, sections"):
        supplied.load_payload(str(path))


def test_stems():
    pairs = dict(caresses="caress", ponies="poni", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor", hopping="hop", falling="fall", filing="file", happy="happi", relational="relat", rational="ration", hopefulness="hope", electrical="electr", adjustment="adjust", adoption="adopt", probate="probat", rate="rate", controlling="control")
    assert {w: stem.stem(w) for w in pairs} == pairs
