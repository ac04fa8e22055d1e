"""Queries over rows in an order: filling, islands, latest rows, pages, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import relations, series, summaries

from .registry import query, table

_FILLED = "CASE WHEN value > 50 THEN event_type END"


@query("forward_fill", f"SELECT event_id, last_value({_FILLED} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kind FROM events")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Types of large events carried on to a user's later ones."""
    return series.forward_fill(table(spark, d, "events").withColumn("kind", F.expr(_FILLED)), ["user_id"], ["ts", "event_id"], ["kind"]).select("event_id", "kind")


_ORDERED = "l_suppkey, l_shipdate, l_orderkey, l_linenumber"


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return series.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("continued_rows", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) > 1 AS continued FROM lineitem")
def continued_rows(spark: SparkSession, d: str) -> DataFrame:
    return series.continued(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "continued").select("l_orderkey", "l_linenumber", "continued")


#: Whole-day intervals from ship dates; a line's quantity is its length in days.
_DAYS = "SELECT l_suppkey, datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS first, datediff('day', DATE '1970-01-01', l_shipdate::DATE) + floor(l_quantity / 10)::BIGINT AS last FROM lineitem"


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey", "cast(datediff(l_shipdate, date'1970-01-01') as long) as first", "datediff(l_shipdate, date'1970-01-01') + floor(l_quantity / 10) as last")


@query("islands_with_gaps", f"""WITH d AS ({_DAYS}), r AS (SELECT *, max(last) OVER (PARTITION BY l_suppkey ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT l_suppkey, min(first) AS first, max(last) AS last, count(*) AS n FROM i GROUP BY l_suppkey, k""")
def islands_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return series.islands(_days(spark, d), ["l_suppkey"], "first", "last", 3)


@query("interval_union", f"""WITH d AS ({_DAYS}), r AS (SELECT *, max(last) OVER (PARTITION BY l_suppkey ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d)
SELECT l_suppkey, sum(greatest(0, last - greatest(first, coalesce(reach, first))))::BIGINT AS covered, max(last) - min(first) AS span FROM r GROUP BY l_suppkey""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return series.covered(_days(spark, d), ["l_suppkey"], "first", "last")


@query("tail_split", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > count(*) OVER (PARTITION BY o_custkey) - greatest(2, ceil(count(*) OVER (PARTITION BY o_custkey) * 0.25)) AS held FROM orders")
def tail_split(spark: SparkSession, d: str) -> DataFrame:
    return series.tail_split(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 0.25, 2).select("o_orderkey", "held")


@query("sliding_runs", "SELECT o_orderkey, array_to_string(run, '') AS run FROM (SELECT o_orderkey, list(o_orderstatus) OVER w AS run, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3")
def sliding_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each three statuses in a row of a customer's orders."""
    found = series.sliding(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus", 3, "run")
    return found.select("o_orderkey", F.array_join("run", "").alias("run"))


@query("newest_per_key", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS rank FROM events WHERE event_type IN ('click', 'view')) WHERE rank <= 20")
def newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty events of two kinds of each user."""
    some = table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("user_id", "event_id", "ts")
    return summaries.top_per_group(some, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).drop("ts")


@query("page_of_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_of_rows(spark: SparkSession, d: str) -> DataFrame:
    return relations.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 50)


@query("newest_rows_ascending", "SELECT * FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) ORDER BY ts, event_id")
def newest_rows_ascending(spark: SparkSession, d: str) -> DataFrame:
    newest = relations.page(table(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 0, 200)
    return newest.orderBy("ts", "event_id")


@query("first_by_priority", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 1")
def first_by_priority(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return relations.page(table(spark, d, "orders").where("o_orderstatus = 'O'"), [rank, F.col("o_orderdate"), F.col("o_orderkey")], 0, 1).select("o_orderkey", "o_orderpriority")


@query("capped_count", "SELECT least(count(*), 1000) AS n, count(*) > 1000 AS capped FROM (SELECT 1 FROM orders LIMIT 1001)")
def capped_count(spark: SparkSession, d: str) -> DataFrame:
    return relations.capped_count(table(spark, d, "orders"), 1000)


@query("value_sample", "SELECT DISTINCT trim(p_name) AS value FROM part WHERE trim(p_name) <> '' ORDER BY 1 LIMIT 10")
def value_sample(spark: SparkSession, d: str) -> DataFrame:
    return summaries.value_sample(table(spark, d, "part"), "p_name", 10)
