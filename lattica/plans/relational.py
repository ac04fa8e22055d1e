"""Queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import geometry, graph, joins, summaries
from lattica.streaming import events as streams

from lattica.sources.shared import save

from .registry import query, table


_NUMBER = "regexp_extract({c}, '#0*([0-9]+)$', 1)"


def _number(c: str):
    return F.regexp_extract(c, "#0*([0-9]+)$", 1)


@query("match_survey", f"SELECT count(CASE WHEN v IN (SELECT {_NUMBER.format(c='s_name')} FROM supplier) THEN 1 END) AS num, count(*) AS den FROM (SELECT DISTINCT {_NUMBER.format(c='c_name')} AS v FROM customer) WHERE v <> ''")
def match_survey(spark: SparkSession, d: str) -> DataFrame:
    """Customers' numbers that suppliers have as well."""
    return joins.match_survey(table(spark, d, "customer"), table(spark, d, "supplier"), _number("c_name"), _number("s_name"))


@query("match_survey_normalised", "WITH k AS (SELECT DISTINCT n_name AS v, regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') AS k FROM nation) SELECT count(CASE WHEN k IN (SELECT 'NATION' || (2 * s_nationkey)::VARCHAR FROM supplier) THEN 1 END) AS num, count(*) AS den FROM k")
def match_survey_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Nations against names in another spelling; every other one of them occurs."""
    return joins.match_survey(table(spark, d, "nation"), table(spark, d, "supplier"), F.col("n_name"), F.concat(F.lit("Nation-"), 2 * F.col("s_nationkey")), "normalised")


@query("key_join", "SELECT n_name, r_name FROM nation LEFT JOIN region ON trim(n_regionkey::VARCHAR) = trim(r_regionkey::VARCHAR)")
def key_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.key_join(table(spark, d, "nation"), table(spark, d, "region"), F.col("n_regionkey"), F.col("r_regionkey")).select("n_name", "r_name")


@query("key_join_orders", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON trim(o_custkey::VARCHAR) = trim(c_custkey::VARCHAR)")
def key_join_orders(spark: SparkSession, d: str) -> DataFrame:
    return joins.key_join(table(spark, d, "orders"), table(spark, d, "customer"), F.col("o_custkey"), F.col("c_custkey")).select("o_orderkey", "c_name")


_WORDS = "SELECT {id}, unnest(list_distinct(list_filter(regexp_split_to_array(upper({c}), '[^A-Z0-9]+'), lambda w: w <> ''))) AS w FROM {t}"
_TYPES = "(SELECT DISTINCT p_type FROM part)"


@query("token_join", f"SELECT DISTINCT p_partkey, p_type FROM ({_WORDS.format(id='p_partkey', c='p_name', t='part')}) JOIN ({_WORDS.format(id='p_type', c='p_type', t=_TYPES)}) USING (w)")
def token_join(spark: SparkSession, d: str) -> DataFrame:
    """Parts and the types whose words their names hold."""
    part = table(spark, d, "part")
    return joins.token_join(part.select("p_partkey", "p_name"), part.select("p_type").distinct(), "p_partkey", "p_type", "p_name", "p_type")


@query("token_join_left", f"SELECT p_partkey, m.p_type FROM part p LEFT JOIN (SELECT DISTINCT p_partkey AS k, p_type FROM ({_WORDS.format(id='p_partkey', c='p_name', t='part')}) JOIN ({_WORDS.format(id='p_type', c='p_type', t=_TYPES)}) USING (w)) m ON m.k = p.p_partkey")
def token_join_left(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return joins.token_join(part.select("p_partkey", "p_name"), part.select("p_type").distinct(), "p_partkey", "p_type", "p_name", "p_type", "left")


@query("token_survey", f"SELECT count(CASE WHEN EXISTS (SELECT 1 FROM ({_WORDS.format(id='p_name', c='p_name', t='(SELECT DISTINCT p_name FROM part)')}) x WHERE x.p_name = v.p_name AND w IN (SELECT upper(p_type) FROM part)) THEN 1 END) AS num, count(*) AS den FROM (SELECT DISTINCT p_name FROM part) v")
def token_survey(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return joins.token_survey(part, part, F.col("p_name"), F.col("p_type"))


@query("keyed_diff", "SELECT coalesce(a.k, b.k) AS id, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.n = b.n THEN 'matched' ELSE 'differing' END AS status FROM (SELECT c_custkey AS k, min(c_nationkey) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_suppkey AS k, min(s_nationkey) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def keyed_diff(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers stand for two versions of a table."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return joins.keyed_diff(customers, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), ["id"], ["nation"])


@query("multiset_match", "SELECT s AS status, least(a.n, b.n) AS matched FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1) b USING (s)")
def multiset_match(spark: SparkSession, d: str) -> DataFrame:
    return joins.multiset_match(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status")), ["status"])


_PROFILED = ["o_orderstatus", "o_orderpriority"]


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS \"distinct\", min({c}) AS least, max({c}) AS greatest FROM orders" for c in _PROFILED))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return summaries.column_profile(table(spark, d, "orders"), _PROFILED)


@query("status_runs", "WITH c AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER w IS NOT DISTINCT FROM o_orderstatus THEN 0 ELSE 1 END AS x FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), r AS (SELECT *, sum(x) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM c) SELECT o_custkey, o_orderstatus, count(*) AS length, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY o_custkey, run, o_orderstatus")
def status_runs(spark: SparkSession, d: str) -> DataFrame:
    return summaries.runs(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus")


@query("top_orders", "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return summaries.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("pivot_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return summaries.pivot_counts(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how, name: customer.join(orders, "c_custkey", how).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query("supplier_parts_components", """WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS x, a AS y FROM n UNION SELECT r.x, n.b FROM r JOIN n ON r.y = n.a) SELECT x AS name, min(y) AS component FROM r GROUP BY x""")
def supplier_parts_components(spark: SparkSession, d: str) -> DataFrame:
    """Brands and types that parts connect, named by the least member."""
    return named_components(table(spark, d, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")))


def named_components(edges: DataFrame) -> DataFrame:
    """name, component (its least name) of edges (a, b) between texts."""
    edges = edges.distinct()
    names = edges.select("a").union(edges.select("b")).distinct().toDF("name").withColumn("key", F.xxhash64("name"))
    root = graph.components(edges.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")))
    named = save(names.join(root, F.col("key") == F.col("node")).select("name", "root"), "named")
    least = save(named.groupBy("root").agg(F.min("name").alias("component")), "least")
    return named.join(least, "root").select("name", "component")


_BOXES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 10 AS page, (l_partkey * 37 % 2000)::DOUBLE AS x0, (l_orderkey * 53 % 2000)::DOUBLE AS y0, (l_partkey * 37 % 2000 + 10 + l_linenumber)::DOUBLE AS x1, (l_orderkey * 53 % 2000 + 8 + l_linenumber)::DOUBLE AS y1, l_returnflag FROM lineitem"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes made from keys by whole-number arithmetic; no table of the driver's has any."""
    x, y = "l_partkey * 37 % 2000", "l_orderkey * 53 % 2000"
    return table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_suppkey % 10 as page", f"cast({x} as double) as x0", f"cast({y} as double) as y0", f"cast({x} + 10 + l_linenumber as double) as x1", f"cast({y} + 8 + l_linenumber as double) as y1", "l_returnflag")


@query("box_overlaps", f"WITH b AS ({_BOXES}) SELECT a.page, a.id AS a_id, c.id AS b_id, (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS area FROM b a JOIN b c ON a.page = c.page AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1 WHERE a.l_returnflag = 'R' AND c.l_returnflag = 'A'")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return geometry.overlaps(b.where("l_returnflag = 'R'"), b.where("l_returnflag = 'A'"), 32.0)


@query("nearest_boxes", f"""WITH b AS ({_BOXES}), g AS (SELECT a.page, a.id AS a_id, c.id AS b_id, greatest(0.0, a.x0 - c.x1, c.x0 - a.x1) AS dx, greatest(0.0, a.y0 - c.y1, c.y0 - a.y1) AS dy
FROM b a JOIN b c ON a.page = c.page AND c.x0 <= a.x1 + 20 AND c.x1 >= a.x0 - 20 AND c.y0 <= a.y1 + 20 AND c.y1 >= a.y0 - 20 WHERE a.l_returnflag = 'R' AND c.l_returnflag = 'A')
SELECT page, a_id, b_id, distance2, rank FROM (SELECT *, dx * dx + dy * dy AS distance2, row_number() OVER (PARTITION BY page, a_id ORDER BY dx * dx + dy * dy, b_id)::INTEGER AS rank FROM g WHERE dx * dx + dy * dy <= 400) WHERE rank <= 2""")
def nearest_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return geometry.nearest(b.where("l_returnflag = 'R'"), b.where("l_returnflag = 'A'"), 20.0, 2, ring=1.0)


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS x FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "30 minutes")


@query("events_once", "SELECT event_id, any_value(user_id) AS user_id FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'click') GROUP BY event_id")
def events_once(spark: SparkSession, d: str) -> DataFrame:
    """Events, of which clicks came twice, each once."""
    events = table(spark, d, "events")
    return streams.deduplicated(events.unionByName(events.where("event_type = 'click'"))).select("event_id", "user_id")


@query("newest_event", "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def newest_event(spark: SparkSession, d: str) -> DataFrame:
    return streams.newest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id")
