"""Queries over logs, surveys, schemas and classes of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import boxes as bx
from lattica.functions import text
from lattica.operators import geometry, joins, relations, series, summaries

from .registry import query, table
from .relational import _BOXES, boxes
from .spatial import _LINES, _PAIR, _SEGMENTS, _points, own_boxes

_OWN = f"SELECT DISTINCT id * 2000 + x0::BIGINT AS id, page, x0, y0, x1, y1, l_returnflag FROM ({_BOXES})"


@query("nearest_by_class", f"""WITH b AS ({_OWN}), g AS (SELECT a.page, a.id AS a_id, c.id AS b_id, CASE a.id % 3 WHEN 0 THEN 4 WHEN 1 THEN 10 ELSE 20 END AS reach, greatest(c.x1 - c.x0, c.y1 - c.y0) AS length,
greatest(0.0, a.x0 - c.x1, c.x0 - a.x1) AS dx, greatest(0.0, a.y0 - c.y1, c.y0 - a.y1) AS dy
FROM b a JOIN b c ON a.page = c.page AND c.x0 <= a.x1 + 20 AND c.x1 >= a.x0 - 20 AND c.y0 <= a.y1 + 20 AND c.y1 >= a.y0 - 20 WHERE a.l_returnflag = 'R' AND c.l_returnflag = 'A')
SELECT page, a_id, b_id, distance2, rank FROM (SELECT *, dx * dx + dy * dy AS distance2, row_number() OVER (PARTITION BY page, a_id ORDER BY dx * dx + dy * dy, length DESC, b_id)::INTEGER AS rank FROM g WHERE dx * dx + dy * dy <= reach * reach) WHERE rank <= 3""")
def nearest_by_class(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest boxes, where three classes look differently far."""
    b = own_boxes(spark, d)
    left = b.where("l_returnflag = 'R'").withColumn("class", F.col("id") % 3)
    return geometry.nearest_by_class(left, b.where("l_returnflag = 'A'"), "class", {"0": 4.0, "1": 10.0, "2": 20.0}, 3)


@query("segment_meetings", f"""WITH b AS ({_BOXES}), h AS ({_LINES[0]}), v AS ({_LINES[1]}), m AS (SELECT h.page, h.id AS a_id, v.id AS b_id, v.x, h.y, least(abs(v.x - h.x0), abs(v.x - h.x1)) <= 1 AS own, least(abs(h.y - v.y0), abs(h.y - v.y1)) <= 1 AS other
FROM h JOIN v ON h.page = v.page AND v.x BETWEEN h.x0 - 1 AND h.x1 + 1 AND h.y BETWEEN v.y0 - 1 AND v.y1 + 1) SELECT DISTINCT page, a_id, b_id, x, y, CASE WHEN own AND other THEN 'corner' WHEN own OR other THEN 'end' ELSE 'cross' END AS kind FROM m""")
def segment_meetings(spark: SparkSession, d: str) -> DataFrame:
    """How boxes' upper sides meet other boxes' left sides."""
    b = boxes(spark, d)
    return geometry.meetings(b.where("l_returnflag = 'R'").withColumn("y", F.col("y0")), b.where("l_returnflag = 'A'").withColumn("x", F.col("x0")), 32.0, 1.0)


@query("reciprocal_within", "WITH p AS (SELECT DISTINCT l_returnflag, l_suppkey AS o, l_partkey AS t FROM lineitem) SELECT a.l_returnflag, a.o AS lo, a.t AS hi FROM p a JOIN p b ON a.l_returnflag = b.l_returnflag AND a.o = b.t AND a.t = b.o WHERE a.o < a.t")
def reciprocal_within(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that refer to each other by lines of one flag."""
    return joins.reciprocal(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", ["l_returnflag"])


@query("survey_sides", """SELECT 'customers' AS relation, true AS surveyed, NULL::VARCHAR AS unbacked, count(*) FILTER (v IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS num, count(*) AS den FROM (SELECT DISTINCT o_custkey AS v FROM orders)
UNION ALL SELECT 'projects', false, 'right', NULL, NULL UNION ALL SELECT 'sheets', false, 'both', NULL, NULL""")
def survey_sides(spark: SparkSession, d: str) -> DataFrame:
    """How many of the customers of orders are solvent, and two relations whose columns are not there."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0")
    of = lambda name, a, b: joins.survey(orders, customer, a, b).select(F.lit(name).alias("relation"), "*")
    return of("customers", "o_custkey", "c_custkey").unionByName(of("projects", "o_custkey", "project")).unionByName(of("sheets", "sheet", "page"))


@query("region_replaced", f"""WITH b AS ({_BOXES}) SELECT page, id, 'old' AS origin FROM b WHERE l_returnflag = 'R' AND NOT (page = 3 AND (x0 + x1) / 2 BETWEEN 400 AND 1400 AND (y0 + y1) / 2 BETWEEN 300 AND 1200)
UNION ALL SELECT page, id, 'new' FROM b WHERE l_returnflag = 'A' AND page = 3 AND x0 BETWEEN 400 AND 1400 AND y0 BETWEEN 300 AND 1200""")
def region_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A page's boxes of a region, replaced by others."""
    b = boxes(spark, d)
    new = b.where("l_returnflag = 'A' and page = 3 and x0 between 400 and 1400 and y0 between 300 and 1200")
    old = b.where("l_returnflag = 'R'").withColumn("origin", F.lit("old"))
    return relations.replaced_in_region(old, new.withColumn("origin", F.lit("new")), 3, (400.0, 300.0, 1400.0, 1200.0)).select("page", "id", "origin")


@query("replayed_events", """WITH s AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000), m AS (SELECT * FROM s WHERE event_type = 'click' AND user_id % 2 = 0)
SELECT event_id, user_id, (SELECT count(*) FROM events) > 1000 OR (SELECT count(*) FROM m) > 50 AS truncated FROM m ORDER BY ts DESC, event_id DESC LIMIT 50""")
def replayed_events(spark: SparkSession, d: str) -> DataFrame:
    """Up to fifty of the newest thousand events, by several conditions, and whether there is more."""
    wanted = (F.col("event_type") == "click") & (F.col("user_id") % 2 == 0)
    return relations.replayed(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], wanted, 1000, 50).select("event_id", "user_id", "truncated")


@query("appended_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def appended_events(spark: SparkSession, d: str) -> DataFrame:
    """A log of the events with even numbers, and those with odd ones added to it, kept to the newest thousand."""
    events = table(spark, d, "events").select("event_id", "ts")
    return relations.appended(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), [F.desc("ts"), F.desc("event_id")], 1000)


@query("clean_counts", "SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) = 0 AS clean FROM orders GROUP BY 1")
def clean_counts(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders by priority, and whether none is of the two first."""
    bad = ["1-URGENT", "2-HIGH"]
    return summaries.clean_counts(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", bad, bad).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high"})


@query("child_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer")
def child_counts(spark: SparkSession, d: str) -> DataFrame:
    """What refers to each customer."""
    return summaries.child_counts(table(spark, d, "customer"), "c_custkey", {"orders": (table(spark, d, "orders"), "o_custkey"), "events": (table(spark, d, "events"), "user_id")})


@query("joined_within", "SELECT o_custkey, o_orderkey AS node, l_linenumber AS part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 20")
def joined_within(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows that hold their orders and lines as arrays, and each order's lines found within its row."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    lines = table(spark, d, "lineitem").where("l_quantity > 20").select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    nodes = orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"))).alias("nodes"))
    parts = lines.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("number"))).alias("parts"))
    found = relations.joined_within(nodes.join(parts, "o_custkey", "left"), "o_custkey", "nodes", "parts", "id", "parent")
    return found.select("o_custkey", F.col("node.id").alias("node"), F.col("part.number").alias("part"))


@query("aligned_rows", "SELECT o_orderkey, o_totalprice AS price, o_custkey::VARCHAR AS o_custkey, TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority, NULL::VARCHAR AS note FROM orders")
def aligned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders in another schema: a column renamed, one as text, one whose values don't fit, one that is new, two left out."""
    return relations.aligned(table(spark, d, "orders"), "o_orderkey bigint, price double, o_custkey string, o_orderpriority int, note string", {"o_totalprice": "price"})


@query("typed_hints", "SELECT p_partkey, coalesce(TRY_CAST(p_brand AS INTEGER), p_size) AS amount, p_name AS label, NULL::DOUBLE AS page FROM part")
def typed_hints(spark: SparkSession, d: str) -> DataFrame:
    """Typed columns found by their names in other spellings."""
    hints = {"amount": (["P BRAND", "P-Size"], "int"), "label": (["title", "p name"], "string"), "page": (["sheet"], "double")}
    return relations.hinted(table(spark, d, "part"), hints).select("p_partkey", *hints)


@query("system_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def system_columns(spark: SparkSession, d: str) -> DataFrame:
    """Orders without columns that are for the system only."""
    return relations.without_columns(table(spark, d, "orders"), ["O_CUSTKEY", "o_totalprice", "o_orderdate", "o_orderpriority", "created_at"])


@query("nested_seals", "SELECT p_partkey, sha256('{~brand~:~' || p_brand || '~,~list~:[{~a~:' || p_size || ',~z~:null},{~a~:1,~z~:~' || p_type || '~}],~size~:{~a~:~x~,~b~:~' || p_name || '~}}') AS seal FROM part".replace("~", '"'))
def nested_seals(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of nested rows, whose fields and keys are in no order."""
    item = lambda z, a: F.struct(z.cast("string").alias("z"), a.alias("a"))
    nested = F.struct(F.create_map(F.lit("b"), "p_name", F.lit("a"), F.lit("x")).alias("size"), F.array(item(F.lit(None), F.col("p_size")), item(F.col("p_type"), F.lit(1))).alias("list"), F.col("p_brand").alias("brand"))
    rows = table(spark, d, "part").select("p_partkey", nested.alias("row"))
    return rows.select("p_partkey", text.json_checksum(F.col("row"), rows.schema["row"].dataType).alias("seal"))


@query("pixel_boxes", f"{_PAIR} SELECT a_id, b_id, round(shared / greatest(a + b - shared, 1), 9) AS iou FROM s")
def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Intersection over union of boxes that touch, in whole pixels."""
    b = boxes(spark, d)
    pairs = geometry._pairs(b.where("l_returnflag = 'R'"), b.where("l_returnflag = 'N'"), 32.0)
    return pairs.select("a_id", "b_id", bx.rounded(bx.pixel_iou(bx.box("a_"), bx.box("b_")), 9).alias("iou"))


@query("pixel_distances", f"""WITH s AS ({_SEGMENTS}), t AS (SELECT *, bx - ax AS dx, ey - ay AS dy FROM s), f AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, ((1000 - ax) * dx + (900 - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS along FROM t)
SELECT id, round(sqrt(power(1000 - floor(ax + along * dx + 0.5), 2) + power(900 - floor(ay + along * dy + 0.5), 2)), 6) AS distance FROM f""")
def pixel_distances(spark: SparkSession, d: str) -> DataFrame:
    """From a point to the pixels that are nearest to it on segments."""
    ends = F.col("x"), F.col("y"), F.col("x") + F.col("id") % 7 * 90 - 270, F.col("y") + F.col("id") % 5 * 120 - 240
    return _points(spark, d).select("id", F.round(bx.pixel_segment_distance(F.lit(1000.0), F.lit(900.0), *ends), 6).alias("distance"))


_NEIGHBOURS = "PARTITION BY user_id ORDER BY ts, event_id"


@query("agreed_types", f"""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind FROM events),
n AS (SELECT event_id, kind, last_value(kind IGNORE NULLS) OVER ({_NEIGHBOURS} ROWS UNBOUNDED PRECEDING) AS before, first_value(kind IGNORE NULLS) OVER ({_NEIGHBOURS} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM e)
SELECT event_id, coalesce(kind, CASE WHEN before = after THEN before END) AS kind FROM n""")
def agreed_types(spark: SparkSession, d: str) -> DataFrame:
    """Events with a third of their types hidden, and given back where a user's types around them agree."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"))
    return series.agreed_fill(events, ["user_id"], ["ts", "event_id"], ["kind"]).select("event_id", "kind")


@query("numbered_orders", """WITH RECURSIVE l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice / 20000)::BIGINT END AS known FROM orders),
s AS (SELECT o_custkey, o_orderkey, k, known AS number, known AS most FROM l WHERE k = 1
UNION ALL SELECT l.o_custkey, l.o_orderkey, l.k, coalesce(known, most + 1), CASE WHEN known IS NULL THEN most + 1 WHEN most IS NULL OR known > most THEN known ELSE most END FROM s JOIN l ON l.o_custkey = s.o_custkey AND l.k = s.k + 1)
SELECT o_orderkey, number FROM s""")
def numbered_orders(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders with a third of their numbers known, and numbered on from the greatest before."""
    known = F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_totalprice") / 20000))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", known.alias("known"))
    return series.numbered_on(orders, ["o_custkey"], ["o_orderkey"], "known", "number").select("o_orderkey", "number")
