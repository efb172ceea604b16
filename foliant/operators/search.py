"""Lexical search over a weighted inverted table."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.stem import STOP_WORDS, stem

#: Weights of title, abstract and subject headings.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def inverted(abstract: DataFrame, mesh_phrase_mode: str = "joined") -> DataFrame:
    """(config, lexeme, pmid, weight, positions), clustered by lexeme.

    Under `simple` lexemes are lowered words, under `english` stems without stop words; positions
    count all words.  Fields follow each other in one sequence of positions.  Subject headings
    are one text, so that a phrase can go from one over to the next; with per_term they are held
    apart by a gap.
    """
    separator = ", " if mesh_phrase_mode == "joined" else " \u0000 "
    fields = [("A", F.col("pubmed.title")), ("B", F.col("pubmed.abstract_text")), ("C", F.array_join("pubmed.mesh_terms", separator))]
    def split(name: str, x: Column) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"({TOKEN}|\u0000)"), 1)
        return F.transform(found, lambda w: F.struct(F.lit(name).alias("weight"), w.alias("word")))

    words = F.flatten(F.array(*(split(name, x) for name, x in fields)))
    rows = abstract.select("pmid", F.posexplode(words).alias("position", "w")).where(F.col("w.word") != "\u0000")
    rows = rows.select("pmid", "position", F.col("w.weight").alias("weight"), F.col("w.word").alias("word"))

    @F.pandas_udf("string")
    def stemmed(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return batch.map(lambda w: known.get(w) or known.setdefault(w, stem(w)))

    simple = rows.select(F.lit("simple").alias("config"), F.col("word").alias("lexeme"), "pmid", "weight", "position")
    english = rows.where(~F.col("word").isin(*STOP_WORDS)).select(F.lit("english").alias("config"), stemmed("word").alias("lexeme"), "pmid", "weight", "position")
    every = simple.unionByName(english)
    return every.groupBy("config", "lexeme", "pmid", "weight").agg(F.sort_array(F.collect_list("position")).alias("positions"))


@dataclass(frozen=True)
class Query:
    """Alternatives, each of phrases that must occur and phrases that must not."""

    alternatives: tuple[tuple[tuple[tuple[str, ...], ...], tuple[tuple[str, ...], ...]], ...]
    config: str


def parse_query(text: str, config: str = "english") -> Query:
    """Words are all asked for, "quoted" ones next to each other; `or` parts alternatives and - excludes."""

    def lexemes(s: str) -> tuple[str, ...]:
        return tuple(stem(w) if config == "english" else w for w in tokens(s) if config != "english" or w not in STOP_WORDS)

    out, must, never = [], [], []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            out.append((tuple(must), tuple(never)))
            must, never = [], []
        elif phrase := lexemes(quoted or word):
            (never if minus else must).append(phrase)
    out.append((tuple(must), tuple(never)))
    return Query(tuple(a for a in out if a[0]), config)


def phrase_query(text: str, config: str = "english") -> Query:
    return parse_query('"' + text.replace('"', " ") + '"', config)


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def search(index: DataFrame, query: Query) -> DataFrame:
    """pmid and rank of the records that match, the sum of the weights of the lexemes' places.

    A query's lexemes are looked up in the index and gathered by record; no more of the table is
    read than their rows.
    """
    wanted = sorted({w for must, never in query.alternatives for p in (*must, *never) for w in p})
    if not wanted:
        return index.select("pmid", F.lit(0.0).alias("rank")).limit(0)
    weight = F.coalesce(*(F.when(F.col("weight") == k, v) for k, v in WEIGHTS.items()))
    rows = index.where((F.col("config") == query.config) & F.col("lexeme").isin(wanted))
    held = rows.groupBy("pmid").agg(*(F.flatten(F.collect_list(F.when(F.col("lexeme") == w, F.col("positions")))).alias(f"_{k}") for k, w in enumerate(wanted)), *(F.sum(F.when(F.col("lexeme") == w, weight * F.size("positions"))).alias(f"_r{k}") for k, w in enumerate(wanted)))
    place = {w: F.col(f"_{k}") for k, w in enumerate(wanted)}
    part = {w: F.coalesce(F.col(f"_r{k}"), F.lit(0.0)) for k, w in enumerate(wanted)}

    def meets(phrase: tuple[str, ...]):
        starts = place[phrase[0]]
        for k, w in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, _moved(place[w], k))
        return F.size(starts) > 0

    found = F.lit(False)
    for must, never in query.alternatives:
        one = F.lit(True)
        for p in must:
            one = one & meets(p)
        for p in never:
            one = one & ~meets(p)
        found = found | one
    asked = sorted({w for must, _ in query.alternatives for p in must for w in p})
    rank = sum((part[w] for w in asked), F.lit(0.0))
    return held.where(found).select("pmid", F.round(rank, 6).alias("rank"))
