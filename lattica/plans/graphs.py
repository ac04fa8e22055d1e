"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graph

from .registry import query, table
from .relational import named_components


@query("nation_components", """WITH RECURSIVE e AS (SELECT DISTINCT c_name AS a, 'n' || c_nationkey::VARCHAR AS b FROM customer UNION SELECT DISTINCT s_name, 'n' || s_nationkey::VARCHAR FROM supplier), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS x, a AS y FROM n UNION SELECT r.x, n.b FROM r JOIN n ON r.y = n.a) SELECT x AS name, min(y) AS component FROM r GROUP BY x""")
def nation_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers that nations connect."""
    of = lambda t, p: table(spark, d, t).select(F.col(f"{p}_name").alias("a"), F.concat(F.lit("n"), f"{p}_nationkey").alias("b"))
    return named_components(of("customer", "c").unionByName(of("supplier", "s")))


_EDGES = "SELECT l_suppkey AS u, 1000000 + l_partkey AS v FROM lineitem"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and the parts that they ship."""
    return table(spark, d, "lineitem").selectExpr("l_suppkey as u", "1000000 + l_partkey as v")


@query("degrees", f"SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ({_EDGES}) UNION ALL SELECT v FROM ({_EDGES})) GROUP BY node")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query("edge_ends", f"SELECT u AS node, 'u' AS side FROM ({_EDGES}) UNION ALL SELECT v, 'v' FROM ({_EDGES})")
def edge_ends(spark: SparkSession, d: str) -> DataFrame:
    return graph.ends(_edges(spark, d), ["u", "v"])


@query("neighbours", f"WITH e AS ({_EDGES}) SELECT DISTINCT u AS node, v AS neighbour FROM e WHERE u IN (1, 2) UNION SELECT DISTINCT v, u FROM e WHERE v IN (1, 2, 1000003)")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), spark.createDataFrame([(1,), (2,), (1000003,)], "node long"))


@query("hops", f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e),
r AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT n.b, r.hops + 1 FROM r JOIN n ON r.node = n.a WHERE r.hops < 2) SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def hops(spark: SparkSession, d: str) -> DataFrame:
    """What two shipments lead to from the first supplier."""
    return graph.hops(_edges(spark, d), spark.createDataFrame([(1,)], "node long"), 2)
