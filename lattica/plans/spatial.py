"""Queries over boxes, points and segments. No table of the driver's has any, so they are made from keys by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import boxes as bx
from lattica.operators import geometry, series, summaries
from lattica.sources.shared import save

from .registry import query, table
from .relational import _BOXES, boxes

_PAIR = f"WITH b AS ({_BOXES}), p AS (SELECT a.id AS a_id, c.id AS b_id, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, c.x0 AS bx0, c.y0 AS by0, c.x1 AS bx1, c.y1 AS by1 FROM b a JOIN b c ON a.page = c.page AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1 WHERE a.l_returnflag = 'R' AND c.l_returnflag = 'N'), s AS (SELECT *, greatest(0.0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0, least(ay1, by1) - greatest(ay0, by0)) AS shared, (ax1 - ax0) * (ay1 - ay0) AS a, (bx1 - bx0) * (by1 - by0) AS b FROM p)"


def own_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with ids that tell them apart: some lines of the table share their number."""
    return boxes(spark, d).withColumn("id", F.col("id") * 2000 + F.col("x0").cast("long")).distinct()


@query("box_measures", f"""{_PAIR} SELECT a_id, b_id, round(shared / (a + b - shared), 9) AS iou, round(shared / a, 9) AS inside, round(shared / least(a, b), 9) AS of_smaller, round((greatest(ax1, bx1) - least(ax0, bx0)) * (greatest(ay1, by1) - least(ay0, by0)), 6) AS joined_area FROM s""")
def box_measures(spark: SparkSession, d: str) -> DataFrame:
    """Of boxes that touch: intersection over union, the contained share, the share of the smaller, the area of the box that holds both."""
    b = boxes(spark, d)
    pairs = geometry._pairs(b.where("l_returnflag = 'R'"), b.where("l_returnflag = 'N'"), 32.0)
    one, two = bx.box("a_"), bx.box("b_")
    nine = lambda c: bx.rounded(c, 9)
    return pairs.select("a_id", "b_id", nine(bx.iou(one, two)).alias("iou"), nine(bx.contained_share(one, two)).alias("inside"), nine(bx.least_area_share(one, two)).alias("of_smaller"), bx.rounded(bx.area(bx.joined(one, two)), 6).alias("joined_area"))


@query("boxes_within", f"""WITH b AS ({_BOXES}), g AS (SELECT a.page, a.id AS a_id, c.id AS b_id, greatest(0.0, a.x0 - c.x1, c.x0 - a.x1) AS dx, greatest(0.0, a.y0 - c.y1, c.y0 - a.y1) AS dy
FROM b a JOIN b c ON a.page = c.page AND c.x0 <= a.x1 + 10 AND c.x1 >= a.x0 - 10 AND c.y0 <= a.y1 + 10 AND c.y1 >= a.y0 - 10 WHERE a.l_returnflag = 'R' AND c.l_returnflag = 'A')
SELECT page, a_id, b_id, dx * dx + dy * dy AS distance2 FROM g WHERE dx * dx + dy * dy <= 100""")
def boxes_within(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return geometry.within(b.where("l_returnflag = 'R'"), b.where("l_returnflag = 'A'"), 10.0)


_POINTS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 10 AS page, (l_partkey * 41 % 2000)::DOUBLE AS x, (l_orderkey * 59 % 2000)::DOUBLE AS y FROM lineitem WHERE l_returnflag = 'A'"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'A'").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_suppkey % 10 as page", "cast(l_partkey * 41 % 2000 as double) as x", "cast(l_orderkey * 59 % 2000 as double) as y")


@query("points_in_boxes", f"WITH b AS ({_BOXES}), p AS ({_POINTS}) SELECT p.page, p.id AS a_id, b.id AS b_id FROM p JOIN b ON p.page = b.page AND p.x >= b.x0 - 2 AND p.x <= b.x1 + 2 AND p.y >= b.y0 - 2 AND p.y <= b.y1 + 2 WHERE b.l_returnflag = 'R'")
def points_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    return geometry.holding(_points(spark, d), boxes(spark, d).where("l_returnflag = 'R'"), 32.0, 2.0)


@query("point_measures", f"""WITH p AS ({_POINTS}), m AS (SELECT *, greatest(0.0, 500 - x, x - 1500) AS ox, greatest(0.0, 400 - y, y - 1600) AS oy, least(1.0, greatest(0.0, ((x - 100) * 900 + (y - 200) * 1200) / 2250000)) AS t FROM p)
SELECT id, round(CASE WHEN ox = 0 AND oy = 0 THEN least(x - 500, 1500 - x, y - 400, 1600 - y) ELSE sqrt(ox * ox + oy * oy) END, 6) AS border, round(sqrt(power(x - (100 + t * 900), 2) + power(y - (200 + t * 1200), 2)), 6) AS segment FROM m""")
def point_measures(spark: SparkSession, d: str) -> DataFrame:
    """From points to a box's border and to a segment."""
    box = tuple(F.lit(v) for v in (500.0, 400.0, 1500.0, 1600.0))
    line = [F.lit(v) for v in (100.0, 200.0, 1000.0, 1400.0)]
    return _points(spark, d).select("id", F.round(bx.border_distance(box, F.col("x"), F.col("y")), 6).alias("border"), F.round(bx.segment_distance(F.col("x"), F.col("y"), *line), 6).alias("segment"))


_LINES = "SELECT id, page, x0, x1, y0 AS y FROM b WHERE l_returnflag = 'R'", "SELECT id, page, x0 AS x, y0, y1 FROM b WHERE l_returnflag = 'A'"


@query("segment_crossings", f"WITH b AS ({_BOXES}), h AS ({_LINES[0]}), v AS ({_LINES[1]}) SELECT h.page, h.id AS a_id, v.id AS b_id, v.x, h.y FROM h JOIN v ON h.page = v.page AND v.x BETWEEN h.x0 - 1 AND h.x1 + 1 AND h.y BETWEEN v.y0 - 1 AND v.y1 + 1")
def segment_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Boxes' upper sides against other boxes' left sides."""
    b = boxes(spark, d)
    return geometry.crossings(b.where("l_returnflag = 'R'").withColumn("y", F.col("y0")), b.where("l_returnflag = 'A'").withColumn("x", F.col("x0")), 32.0, 1.0)


_SEGMENTS = f"SELECT id, x AS ax, y AS ay, x + id % 7 * 90 - 270 AS bx, y + id % 5 * 120 - 240 AS ey FROM ({_POINTS})"


@query("segment_measures", f"""WITH s AS ({_SEGMENTS}), t AS (SELECT *, bx - ax AS dx, ey - ay AS dy FROM s), c AS (SELECT *,
greatest(0.0, CASE WHEN dx <> 0 THEN least((500 - ax) / dx, (1500 - ax) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((400 - ay) / dy, (1600 - ay) / dy) ELSE 0 END) AS lo,
least(1.0, CASE WHEN dx <> 0 THEN greatest((500 - ax) / dx, (1500 - ax) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((400 - ay) / dy, (1600 - ay) / dy) ELSE 1 END) AS hi FROM t)
SELECT id, round(sqrt(dx * dx + dy * dy), 6) AS length, CASE WHEN dx = 0 AND dy = 0 THEN 'point' WHEN dy = 0 THEN 'h' WHEN dx = 0 THEN 'v' ELSE 'other' END AS orientation, lo <= hi AND NOT (dx = 0 AND (ax < 500 OR ax > 1500)) AND NOT (dy = 0 AND (ay < 400 OR ay > 1600)) AS meets FROM c""")
def segment_measures(spark: SparkSession, d: str) -> DataFrame:
    """Segments' lengths and orientations, and whether they meet a box."""
    ends = F.col("x"), F.col("y"), F.col("x") + F.col("id") % 7 * 90 - 270, F.col("y") + F.col("id") % 5 * 120 - 240
    box = tuple(F.lit(v) for v in (500.0, 400.0, 1500.0, 1600.0))
    return _points(spark, d).select("id", F.round(bx.segment_length(*ends), 6).alias("length"), bx.orientation(*ends).alias("orientation"), bx.segment_meets_box(*ends, box).alias("meets"))


@query("region_lookup", f"SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY id * 7919 % 1000 DESC, id)::INTEGER AS rank FROM ({_BOXES}) WHERE x0 <= 700 AND x1 >= 500 AND y0 <= 900 AND y1 >= 600")
def region_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of a region by falling score."""
    region = tuple(F.lit(v) for v in (500.0, 600.0, 700.0, 900.0))
    score = F.col("id") * 7919 % 1000
    found = boxes(spark, d).where(bx.touches(bx.box(), region)).withColumn("score", score)
    return summaries.ranked(found, ["page"], [F.desc("score"), F.col("id")]).select("page", "id", "rank")


@query("reading_order", f"SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id)::INTEGER AS rank FROM ({_BOXES})")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return summaries.ranked(boxes(spark, d), ["page"], [F.col("y0"), F.col("x0"), F.col("id")]).select("page", "id", "rank")


@query("line_bands", f"""WITH RECURSIVE b AS (SELECT DISTINCT page, y0 FROM ({_BOXES})), a AS (SELECT page, min(y0) AS y FROM b GROUP BY page UNION SELECT a.page, (SELECT min(y0) FROM b WHERE b.page = a.page AND b.y0 >= a.y + 12) FROM a WHERE a.y IS NOT NULL)
SELECT page, id, (SELECT max(y) FROM a WHERE a.page = x.page AND a.y <= x.y0) AS band FROM ({_BOXES}) x""")
def line_bands(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by lines of text: a line takes what begins less than 12 below its first box."""
    return series.bands(boxes(spark, d), ["page"], "y0", 12.0).select("page", "id", "band")


@query("rectangles", f"""WITH b AS (SELECT id * 2000 + x0::BIGINT AS id, page, x0, y0, x1, y1 FROM ({_BOXES}) WHERE l_returnflag = 'R'), h AS (SELECT id * 2 AS id, page, x0, x1, y0 AS y FROM b UNION ALL SELECT id * 2 + 1, page, x0, x1, y1 FROM b), v AS (SELECT id * 2 AS id, page, x0 AS x, y0, y1 FROM b UNION ALL SELECT id * 2 + 1, page, x1, y0, y1 FROM b)
SELECT DISTINCT t.page, t.id AS top, o.id AS bottom, l.id AS left_, r.id AS right_ FROM h t JOIN v l ON l.page = t.page AND l.x = t.x0 AND l.y0 = t.y JOIN v r ON r.page = t.page AND r.x = t.x1 AND r.y0 = t.y JOIN h o ON o.page = t.page AND o.x0 = l.x AND o.x1 = r.x AND o.y = l.y1 AND o.y = r.y1""")
def rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Four segments that close, found again among the sides of boxes."""
    # their sides are read four times
    b = save(own_boxes(spark, d).where("l_returnflag = 'R'").select("id", "page", *geometry.BOX), "boxes")
    across = b.selectExpr("id * 2 as id", "page", "x0", "x1", "y0 as y").union(b.selectExpr("id * 2 + 1", "page", "x0", "x1", "y1"))
    upright = b.selectExpr("id * 2 as id", "page", "x0 as x", "y0", "y1").union(b.selectExpr("id * 2 + 1", "page", "x1", "y0", "y1"))
    return geometry.rectangles(across, upright, 32.0).select("page", "top", "bottom", "left_", "right_")


@query("scaled_boxes", f"SELECT id, round(least(900.0, greatest(0.0, x0 * 0.48)), 6) AS x0, round(least(800.0, greatest(0.0, y1 * 0.48)), 6) AS y1, floor(x0 / 3 + 0.5)::BIGINT::VARCHAR || ',' || floor(y0 / 3 + 0.5)::BIGINT::VARCHAR AS node FROM ({_BOXES})")
def scaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in another resolution, within a page, and the keys of the grid nodes that their corners round to."""
    own = bx.scaled(bx.box(), 0.48, 900.0, 800.0)
    return boxes(spark, d).select("id", F.round(own[0], 6).alias("x0"), F.round(own[3], 6).alias("y1"), bx.grid_key(F.col("x0"), F.col("y0"), 3.0).alias("node"))


@query("grid_clusters", f"SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM ({_POINTS}) GROUP BY floor(x / 30 + 0.5), floor(y / 30 + 0.5) HAVING count(*) >= 3")
def grid_clusters(spark: SparkSession, d: str) -> DataFrame:
    return summaries.grid_clusters(_points(spark, d), 30.0, 3).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query("page_bounds", f"SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_BOXES}) GROUP BY page")
def page_bounds(spark: SparkSession, d: str) -> DataFrame:
    return summaries.bounds(boxes(spark, d), ["page"])


@query("box_suppression")
def box_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression; each decision depends on those before it, so the test compares it with the sequential loop."""
    scored = own_boxes(spark, d).withColumn("score", F.pmod(F.xxhash64("id"), F.lit(1000)))
    return geometry.suppressed(scored, 0.45, 32.0)


@query("greedy_assignment")
def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each box to one other within reach, nearest first, each used once; compared with the sequential loop in the tests."""
    b = own_boxes(spark, d)
    return geometry.assigned(b.where("l_returnflag = 'R'"), b.where("l_returnflag = 'A'"), 10.0)
