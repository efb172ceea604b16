"""The pipeline against a brute-force version: each stage on what its predecessor kept."""

import brute
import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from foliant.llm import neighbours, packing
from foliant.llm.queries import train_labels

DATA = "/root/testdata/sf0.001"


def cut_lines(docs, run=3):
    """docs: sorted (id, text).  Texts without later repeated runs of lines."""
    first, gone, worded = {}, {}, {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        worded[doc] = [k for k, x in enumerate(lines) if brute.SPACE.search(x)]
        for i in range(len(worded[doc]) - run + 1):
            at = worded[doc][i : i + run]
            if first.setdefault(tuple(lines[k] for k in at), (doc, i)) != (doc, i):
                gone.setdefault(doc, set()).update(at)
    return {doc: "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone.get(doc, ())) for doc, text in docs}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], DATA).persist())
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, stages):
    docs, good, cut, single, clean, packed = stages
    for df in stages[1:5]:
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    space = neighbours.fit(docs, train_labels(spark, DATA))
    keep = {r.doc_id for r in neighbours.score(docs, space).where(F.col("score") >= 0.3).collect()}
    assert {d for d, _ in texts(good)} == keep
    want = cut_lines(texts(good))
    assert dict(texts(cut)) == want and all(r.n_chars == len(r.text) for r in cut.collect())
    near = brute.near_components(texts(cut))
    assert texts(single) == [(d, t) for d, t in texts(cut) if near[d][1] == d]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hit = brute.decontaminated(texts(single), items)
    assert texts(clean) == [(d, t) for d, t in texts(single) if not hit[d][-1]]
    lengths = {d: len(packing.encoder(packing.default_tokenizer())(t)) + 1 for d, t in texts(clean)}
    rows = packed.collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == lengths


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    assert stages[1].join(labels, "doc_id", "left_semi").count() >= 0.97 * labels.count()


def test_run(spark, stages):
    assert P.run(spark, DATA).count() == stages[-1].count()
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_nulls_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text of no one", "en", "s", 14), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        n = P.run(spark, folder).count()
        assert n == (5 if name == "some" else 0)


def test_columns_of_any_name_stay(spark):
    names = ["_lines", "_deleted", "component_id", "_id", "_text", "_row", "score", "label", "uid", "key"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    wide = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for _, stage in P.STAGES[:4]:
        got, plain = stage(spark, wide, DATA), stage(spark, docs, DATA)
        assert got.columns == wide.columns
        assert sorted(got.select(docs.columns).collect()) == sorted(plain.collect())
        assert got.where(" and ".join(f"`{n}` = {k}" for k, n in enumerate(names))).count() == plain.count()
