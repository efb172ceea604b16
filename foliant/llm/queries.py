"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, jaccard, lines, neighbours, oracles, packing, pages, pitman_yor, rules, substring, toxicity
from foliant.llm._shared import dropped, table


def _remainder(n: int, column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string")) % n


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(_remainder(5) != 0)


def _predicted(scored: DataFrame, least: float) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"), *(c for c in scored.columns if c not in ("doc_id", "score")),
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(neighbours.score(docs, neighbours.fit(docs, train_labels(spark, sf_dir))), 0.3)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), "text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), texts=False)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))
    model, vocabulary = pitman_yor.fit(docs.where(~held_out), others=docs.where(held_out))
    scored = pitman_yor.score(docs, model, vocabulary, trained=~held_out)
    for done in (vocabulary, model.pairs):
        dropped(done)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), train_labels(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 counts before any rule, which SQL can express."""
    counted = rules.statistics(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.base_failed().alias("base_failed"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(toxicity.score(docs, toxicity.fit(docs, train_labels(spark, sf_dir))), 0.5)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_model": op7_language_model,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "text_statistics": text_statistics,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.ORACLE,
    "op5_benchmark_decontamination": oracles.DECONTAMINATION,
    "op6_substring_dedup": oracles.SUBSTRING,
    "op9_ngram_jaccard_join": oracles.JACCARD,
    "text_statistics": oracles.STATISTICS,
}
