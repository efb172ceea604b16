import brute
import duckdb

from foliant.llm import queries

DATA = "/root/testdata/sf0.001"


def test_sql_equals_brute_force():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    docs, items = con.sql("SELECT doc_id, text FROM documents").fetchall(), con.sql("SELECT item_id, text FROM benchmark").fetchall()
    assert {r[0]: r[1:] for r in con.sql(queries.ORACLES["op5_benchmark_decontamination"]).fetchall()} == brute.decontaminated(docs, items)
    assert {r[0]: r[1:] for r in con.sql(queries.ORACLES["op6_substring_dedup"]).fetchall()} == brute.deduplicated(docs)


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DATA)
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())
