import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lattica.operators import geometry, graph, joins, summaries
from lattica.plans import registry
from lattica.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"SELECT {columns} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_entry_imports():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_joins_with_blanks_and_nulls(spark):
    a = spark.createDataFrame([(1, " x "), (2, ""), (3, None), (4, "A-1, b2")], "i int, s string")
    b = spark.createDataFrame([(9, "x"), (8, "a 1"), (7, "")], "j int, t string")
    assert {(r.i, r.j) for r in joins.key_join(a, b, F.col("s"), F.col("t")).collect()} == {(1, 9), (2, None), (3, None), (4, None)}
    assert {tuple(r) for r in joins.token_join(a, b, "i", "j", "s", "t").collect()} == {(1, 9), (4, 8)}  # A and 1 are words of both
    assert joins.match_survey(a, b, F.col("s"), F.col("t")).first() == (1, 2)
    assert joins.match_survey(a.limit(0), b, F.col("s"), F.col("t")).first() == (0, 0)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60) if k != 30], "u long, v long")
    root = {r.node: r.root for r in graph.components(edges).collect()}
    assert len({root[k] for k in range(31)}) == 1 and len({root[k] for k in range(31, 61)}) == 1 and root[0] != root[60]


def test_overlaps_equal_brute_force(spark):
    rows = [(k, 0, float(k * 7 % 50), float(k * 11 % 50), float(k * 7 % 50 + 5 + k % 9), float(k * 11 % 50 + 4)) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, page int, x0 double, y0 double, x1 double, y1 double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]}
    got = geometry.overlaps(df, df, 8.0).collect()
    assert {(r.a_id, r.b_id) for r in got} == want and len(got) == len(want)


def test_stream_counts_equal_batch(spark, tmp_path):
    table = spark.createDataFrame([(k, k % 3, "ab"[k % 2], float(k), f"2024-01-01 0{k % 4}:10:00") for k in range(40)], "event_id long, user_id long, event_type string, value double, t string")
    table = table.selectExpr("event_id", "user_id", "event_type", "value", "cast(t as timestamp) as ts")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = events.windowed(stream, "1 hour", "1 day").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.windowed(table, "1 hour").collect()))


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "x")], "g int, k int, v string")
    assert sorted(tuple(r) for r in summaries.runs(df, ["g"], ["k"], "v").select("length", "first").collect()) == [(1, 3), (2, 1)]
