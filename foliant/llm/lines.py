"""Line deduplication by winnowing, in DataFrame operations only.

Lines are hashed, and of each `run` lines that follow each other the smallest hash is selected.
The selected lines are the fingerprints, about half of all for runs of three: texts that have
`run` equal lines in a row have one in common, wherever the run stands.  Fingerprints are joined by
their hash; those that occur at one place only go no further.  From each joined position the match
is extended both ways, over the lines before and after it that its windows reach, and every run
found so is compared with its first occurrence.  All lines of later runs are deleted; a longer
match is the union of its runs.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 3
#: A line with a word; other lines have no part in runs and stay.
WORD = r"[^\x20\x09-\x0D]"


def _least(o: int, run: int) -> Column:
    """Whether the line at shift 0 is the first smallest one of the window that begins o lines before it."""
    out = F.lit(True)
    for k in range(-o, run - o):
        if k:
            out = out & (F.col(f"h{k}") > F.col("h0") if k < 0 else F.col(f"h{k}") >= F.col("h0"))
    return F.coalesce(out, F.lit(False))  # without a line there is no window


def fingerprints(docs: DataFrame, id_col: str, text_col: str, run: int) -> DataFrame:
    """A row for each selected line: doc_id, text_key, and hashes h and line numbers k of it (0) and
    its neighbours among the lines with a word (by their shift, -1 for the one before)."""
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.struct(F.xxhash64(x).alias("h"), k.alias("k"), x.rlike(WORD).alias("word")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.filter(lines, lambda x: x["word"]).alias("lines"))
    shifts = range(1 - run, run)
    none = F.lit(None).cast("struct<h:bigint,k:int,word:boolean>")
    moved = [F.slice("lines", k + 1, F.size("lines")) if k > 0 else F.concat(F.array_repeat(none, -k), "lines") if k else F.col("lines") for k in shifts]
    beside = F.arrays_zip(*(m.alias(f"s{k}") for m, k in zip(moved, shifts, strict=True)))
    each = rows.select("doc_id", "text_key", F.explode(beside).alias("x")).select("doc_id", "text_key", *(F.col(f"x.s{k}.{c}").alias(f"{c}{k}") for c in "hk" for k in shifts))
    return each.where(reduce(or_, [_least(o, run) for o in range(run)]))


def deleted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, text_key, gone): the numbers of the lines that `deduplicate` deletes, where there are any."""
    prints = fingerprints(docs, id_col, text_col, run)
    place = F.struct("doc_id", "text_key", "k0")
    several = prints.groupBy("h0").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h0")
    joined = prints.join(several, "h0", "left_semi")

    def extended(o: int) -> Column:
        """The run that begins o lines before the joined position."""
        hashes = [F.col(f"h{k}") for k in range(-o, run - o)]
        return F.when(_least(o, run), F.struct(F.xxhash64(*hashes).alias("x"), F.xxhash64(F.lit(run), *reversed(hashes)).alias("y"), F.array(*(f"k{k}" for k in range(-o, run - o))).alias("at")))

    runs = joined.select("doc_id", "text_key", F.inline(F.array_compact(F.array(*(extended(o) for o in range(run))))))
    begin = F.struct("doc_id", "text_key", F.col("at")[0].alias("begin"))
    first = runs.groupBy("x", "y").agg(F.min(begin).alias("first"), F.max(begin).alias("last")).where("first <> last").select("x", "y", "first")
    later = runs.join(first, ["x", "y"]).where(begin > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """The columns of `docs`, with later repeated lines cut from the text, and _lines and _deleted
    (with more underscores, if `docs` has columns of these names).

    A line goes if it is one of `run` lines in a row, lines without words not counted, that
    occur in the same order at an earlier place: in a smaller document, or further up.  Lines
    are split by line feeds and must be equal to the byte.  The first occurrence of a run stays,
    but for lines that it shares with a later, overlapping one.  A null text stays null, with 0
    lines; an empty one stays empty.  Rows with the same id and text are at the same place and
    don't delete from each other; of different texts with one id the order is that of their
    hashes, and each loses its own lines only.  A row without an id stays whole and deletes nothing.
    """
    found = deleted(docs, id_col, text_col, run).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("gone").alias("_gone"))
    # the lines are split below the join: within a lambda they would be split again for each line
    split = docs.select(F.struct(*(c for c in docs.columns if c != text_col)).alias("_row"), F.col(id_col).alias("_doc"), F.xxhash64(F.col(text_col).cast("string")).alias("_text"), F.split(F.col(text_col).cast("string"), "\n").alias("_parts"))
    split = split.withColumn("_text", F.when(F.col("_parts").isNotNull(), F.col("_text")))
    out = split.join(found, (F.col("_doc") == F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_parts")).otherwise(F.transform(left, lambda k: F.get("_parts", k)))
    text = F.array_join(kept, "\n").cast(docs.schema[text_col].dataType)
    counts = {"_lines": F.when(F.col("_parts").isNull(), 0).otherwise(F.size("_parts")), "_deleted": F.coalesce(F.size("_gone"), F.lit(0))}
    return out.select(*((text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns), *(x.cast("long").alias(free_name(c, docs)) for c, x in counts.items()))


def free_name(name: str, docs: DataFrame) -> str:
    """The name, with more underscores before it while `docs` has such a column."""
    while name in docs.columns:
        name = "_" + name
    return name


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), worded AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
  SELECT doc_id, k, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS nth FROM runs WHERE c IS NOT NULL) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, k + d AS k FROM later, (VALUES (0), (1), (2)) AS t(d)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n
  FROM lines l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.i = w.i LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.k = g.k
  WHERE g.k IS NULL GROUP BY l.doc_id
), total AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_lines, coalesce(t.n, 0) - coalesce(k.n, 0) AS n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN total t ON d.doc_id = t.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
