import time

import duckdb
import pandas as pd

from foliant.llm import lines as L


def test_equals_oracle_on_edges(spark):
    block = "alpha\nbeta\ngamma\ndelta"
    docs = [
        (1, f"intro\n{block}\nend"), (2, f"other\n\n{block}\n"), (3, "beta\ngamma"), (4, "alpha\n\nbeta\n \ngamma"), (5, None), (6, ""), (7, "x\nx\nx\nx\nx"),
        (8, f"{block}\n{block}"), (9, "\n" * 50), (10, "line\n" * 3000), (11, "alpha \nbeta\ngamma"), (12, block),
    ]
    frame = spark.createDataFrame([(*d, "a", 1, "i", [1]) for d in docs], "doc_id long, text string, gone string, _lines int, _id string, _gone array<int>").repartition(4)
    got = sorted((r.doc_id, r["__lines"], r["_deleted"], r.text) for r in L.deduplicate(frame).collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    assert got == sorted(con.sql(L.ORACLE).fetchall())
    text = {r[0]: r[3] for r in got}
    assert text[2] == "other\n\n" and text[1].endswith("end") and text[12] == "" and text[5] is None
    assert L.deduplicate(frame).columns == [*frame.columns, "__lines", "_deleted"]
    assert L.deduplicate(frame.limit(0)).count() == 0


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")]
    got = L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.text for r in got] == ["a\nb\nc"] * 3


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = L.deduplicate(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_that_share_an_id_keep_their_own_lines(spark):
    rows = [(1, "a1\nb1\nc1"), (2, "a1\nb1\nc1\nd"), (2, "k\nl\nm\nn"), (3, "l\nm\nn")]
    got = sorted((r.doc_id, r.text, r["_deleted"]) for r in L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a1\nb1\nc1", 0), (2, "d", 3), (2, "k\nl\nm\nn", 0), (3, "", 3)]


def test_only_some_lines_are_fingerprints(spark):
    text = "\n".join(f"line {k}" for k in range(3000))
    n = L.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", 3).count()
    assert 1000 <= n <= 1700


def test_time_grows_with_the_lines(spark):
    def seconds(n):
        rows = [(1, "x\ny\nz"), (2, "\n".join(f"line {k}" for k in range(n)) + "\nx\ny\nz")]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.time()
        assert sorted(r["_deleted"] for r in L.deduplicate(frame).collect()) == [0, 3]
        return time.time() - began

    seconds(100)
    assert seconds(200_000) < 20
