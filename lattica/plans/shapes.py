"""Queries over intervals, pieces of lines, segments and rasters. No table of the driver's has any, so they are made from keys by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import geometry, graph, joins, planar, raster, relations, series, signatures
from lattica.sources.shared import in_order, save

from .registry import query, table
from .relational import _BOXES, boxes

_STAYS = "SELECT l_partkey, l_returnflag, l_orderkey * 53 % 4000 AS first, l_orderkey * 53 % 4000 + l_linenumber * 37 % 400 AS last FROM lineitem"


def _stays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_partkey", "l_returnflag", "l_orderkey * 53 % 4000 as first", "l_orderkey * 53 % 4000 + l_linenumber * 37 % 400 as last")


@query("interval_rest", f"""WITH s AS ({_STAYS}), p AS (SELECT l_partkey, unnest([first, last]) AS pos, l_returnflag = 'N' AS b FROM s WHERE first < last), q AS (SELECT DISTINCT l_partkey, pos FROM p),
g AS (SELECT l_partkey, pos, lead(pos) OVER (PARTITION BY l_partkey ORDER BY pos) AS upto FROM q), f AS (
  SELECT g.* FROM g WHERE EXISTS (SELECT 1 FROM s WHERE s.l_partkey = g.l_partkey AND l_returnflag <> 'N' AND first <= pos AND upto <= last)
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.l_partkey = g.l_partkey AND l_returnflag = 'N' AND first <= pos AND upto <= last)),
r AS (SELECT *, coalesce((pos <> lag(upto) OVER (PARTITION BY l_partkey ORDER BY pos))::INTEGER, 1) AS begins FROM f), k AS (SELECT *, sum(begins) OVER (PARTITION BY l_partkey ORDER BY pos) AS run FROM r)
SELECT l_partkey, min(pos) AS first, max(upto) AS last FROM k GROUP BY l_partkey, run""")
def interval_rest(spark: SparkSession, d: str) -> DataFrame:
    """When parts were out as returned or accepted lines and not as new ones."""
    rows = _stays(spark, d)
    return series.remaining(rows.where("l_returnflag <> 'N'"), rows.where("l_returnflag = 'N'"), ["l_partkey"], "first", "last")


_PIECES = "SELECT l_suppkey, l_partkey * 37 % 9000 AS y, l_orderkey * 53 % 3000 AS first, l_orderkey * 53 % 3000 + l_linenumber * 11 % 40 AS last FROM lineitem"
_ISLANDS = """r AS (SELECT *, max(last) OVER (PARTITION BY l_suppkey, line ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach + 25 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey, line ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT l_suppkey, line, min(y) AS lo, max(y) AS hi, min(first) AS first, max(last) AS last, count(*) AS n FROM i GROUP BY l_suppkey, line, k"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey", "l_partkey * 37 % 9000 as y", "l_orderkey * 53 % 3000 as first", "l_orderkey * 53 % 3000 + l_linenumber * 11 % 40 as last")


@query("chained_pieces", f"""WITH p AS ({_PIECES}), v AS (SELECT l_suppkey, y AS v, y - lag(y) OVER (PARTITION BY l_suppkey ORDER BY y) AS step FROM (SELECT DISTINCT l_suppkey, y FROM p)),
w AS (SELECT l_suppkey, v, max(CASE WHEN step IS NULL OR step > 12 THEN v END) OVER (PARTITION BY l_suppkey ORDER BY v) AS line FROM v), l AS (SELECT p.*, line FROM p JOIN w ON p.l_suppkey = w.l_suppkey AND y = v), {_ISLANDS}""")
def chained_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces along lines, whose heights follow each other by 12 at most, bridged over gaps of 25."""
    return series.chained(_pieces(spark, d), ["l_suppkey"], "y", 12, "first", "last", 25)


@query("anchored_pieces", f"""WITH RECURSIVE p AS ({_PIECES}), v AS (SELECT DISTINCT l_suppkey, y AS v FROM p), b AS (
  SELECT l_suppkey, min(v) AS line FROM v GROUP BY l_suppkey UNION ALL SELECT b.l_suppkey, (SELECT min(v) FROM v WHERE v.l_suppkey = b.l_suppkey AND v.v > b.line + 12) FROM b WHERE b.line IS NOT NULL),
l AS (SELECT p.*, (SELECT max(line) FROM b WHERE b.l_suppkey = p.l_suppkey AND line <= y) AS line FROM p), {_ISLANDS}""")
def anchored_pieces(spark: SparkSession, d: str) -> DataFrame:
    """As chained_pieces, where a line ends 12 behind its first height."""
    return series.chained(_pieces(spark, d), ["l_suppkey"], "y", 12, "first", "last", 25, anchored=True).withColumn("line", F.col("line").cast("long"))


@query("mutual_pairs", f"""WITH b AS ({_BOXES}), g AS (SELECT DISTINCT a.id AS a_id, c.id AS b_id, greatest(0.0, a.x0 - c.x1, c.x0 - a.x1) AS dx, greatest(0.0, a.y0 - c.y1, c.y0 - a.y1) AS dy
FROM b a JOIN b c ON a.page = c.page AND c.x0 <= a.x1 + 10 AND c.x1 >= a.x0 - 10 AND c.y0 <= a.y1 + 10 AND c.y1 >= a.y0 - 10 WHERE a.l_returnflag = 'R' AND c.l_returnflag = 'A'),
p AS (SELECT DISTINCT a_id, b_id FROM g WHERE dx * dx + dy * dy <= 100),
one AS (SELECT a_id, b_id FROM (SELECT *, count(*) OVER (PARTITION BY a_id) AS na, count(*) OVER (PARTITION BY b_id) AS nb FROM p) WHERE na = 1 AND nb = 1),
q AS (SELECT * FROM p WHERE a_id NOT IN (SELECT a_id FROM one) AND b_id NOT IN (SELECT b_id FROM one)),
two AS (SELECT a_id, b_id FROM (SELECT *, count(*) OVER (PARTITION BY a_id) AS na, count(*) OVER (PARTITION BY b_id) AS nb FROM q) WHERE na = 1 AND nb = 1)
SELECT a_id, b_id, 1 AS round FROM one UNION ALL SELECT a_id, b_id, 2 FROM two""")
def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Returned and accepted lines' boxes that have no other one near."""
    b = boxes(spark, d)
    return geometry.mutual_within(b.where("l_returnflag = 'R'"), b.where("l_returnflag = 'A'"), 10.0).withColumn("round", F.lit(1))


# segments on a grid of tens: across for even lines, upright for odd ones
_SEGMENTS = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id, * FROM (SELECT *, l_suppkey % 25 * 1000 + l_orderkey % 40 AS page, l_partkey * 37 % 100 * 10 AS x0, l_orderkey * 53 % 100 * 10 AS y0, l_linenumber % 2 AS up, (1 + l_partkey % 4) * 10 AS size FROM lineitem)"
_CUT = f"""s AS (SELECT id, page, x0, y0, x0 + CASE WHEN up = 0 THEN size ELSE 0 END AS x1, y0 + CASE WHEN up = 1 THEN size ELSE 0 END AS y1 FROM ({_SEGMENTS})), e AS (SELECT DISTINCT page, x, y FROM (SELECT page, x0 AS x, y0 AS y FROM s UNION ALL SELECT page, x1, y1 FROM s)),
c AS (SELECT s.page, id, e.x || ',' || e.y AS u, e.x - x0 + e.y - y0 AS pos FROM s JOIN e ON s.page = e.page AND e.x BETWEEN x0 AND x1 AND e.y BETWEEN y0 AND y1),
p AS (SELECT * FROM (SELECT page, id, row_number() OVER w AS piece, u, lead(u) OVER w AS v FROM c WINDOW w AS (PARTITION BY page, id ORDER BY pos)) WHERE v IS NOT NULL)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines that repeat get an id each."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = in_order(table(spark, d, "lineitem").select(order), order, "place")
    at = rows.selectExpr("place + 1 as id", "l_suppkey % 25 * 1000 + l_orderkey % 40 as page", "l_partkey * 37 % 100 * 10 as x0", "l_orderkey * 53 % 100 * 10 as y0", "l_linenumber % 2 as up", "(1 + l_partkey % 4) * 10 as size")
    return at.selectExpr("id", "page", "x0", "y0", "x0 + if(up = 0, size, 0) as x1", "y0 + if(up = 1, size, 0) as y1")


@query("segment_pieces", f"WITH {_CUT} SELECT * REPLACE (piece::INTEGER AS piece) FROM p")
def segment_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Segments cut where others' ends lie on them."""
    return planar.pieces(_segments(spark, d), 32.0, 1.0)


# a place whose coordinates add up to a multiple of 170 is a barrier
_STOPS = "(split_part({0}, ',', 1)::BIGINT + split_part({0}, ',', 2)::BIGINT) % 170 = 0"


@query("segment_nets", f"""WITH RECURSIVE {_CUT}, n AS MATERIALIZED (SELECT page, id, piece, CASE WHEN {_STOPS.format('u')} THEN u || '/' || id || '/' || piece || '/u' ELSE u END AS a, CASE WHEN {_STOPS.format('v')} THEN v || '/' || id || '/' || piece || '/v' ELSE v END AS b FROM p),
g AS MATERIALIZED (SELECT page, a, b FROM n UNION SELECT page, b, a FROM n), reach AS (SELECT page, a AS node, a AS far FROM g UNION SELECT r.page, r.node, g.b FROM reach r JOIN g ON r.page = g.page AND r.far = g.a),
least AS (SELECT page, node, min(id) AS net FROM reach JOIN n USING (page) WHERE n.a = far GROUP BY page, node)
SELECT p.page, p.id, p.piece::INTEGER AS piece, net FROM p JOIN n USING (page, id, piece) JOIN least l ON l.page = n.page AND l.node = n.a""")
def segment_nets(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that are connected without passing a barrier."""
    segments = _segments(spark, d)
    ends = segments.select("page", F.col("x0").alias("x"), F.col("y0").alias("y")).union(segments.select("page", "x1", "y1"))
    return planar.netted(segments, ends.where("(x + y) % 170 = 0"), 32.0, 1.0).select("page", "id", "piece", "net")


# outlines of boxes in frames of 60 x 40
_WALLS = "SELECT DISTINCT page, x, y FROM (SELECT page, x, unnest(range(y0, y1 + 1)) AS y, x0, x1, y0, y1 FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM (SELECT l_orderkey % 300 AS page, l_partkey * 37 % 57 AS x0, l_orderkey * 53 % 37 AS y0, l_partkey * 37 % 57 + 2 + l_linenumber AS x1, l_orderkey * 53 % 37 + 2 + l_quantity::BIGINT % 5 AS y1 FROM lineitem WHERE l_linenumber = 1))) WHERE (x IN (x0, x1) OR y IN (y0, y1)) AND x < 60 AND y < 40"


@query("enclosed_regions", f"""WITH RECURSIVE w AS MATERIALIZED ({_WALLS}), f AS (SELECT DISTINCT l_orderkey % 300 AS page FROM lineitem WHERE l_linenumber = 1), cell AS MATERIALIZED (
  SELECT page, x, y FROM f, (SELECT unnest(range(60)) AS x), (SELECT unnest(range(40)) AS y) EXCEPT SELECT page, x, y FROM w),
outer_ AS (SELECT page, x, y FROM cell WHERE x IN (0, 59) OR y IN (0, 39) UNION SELECT c.page, c.x, c.y FROM outer_ o, (SELECT unnest([-1, 1, 0, 0]) AS dx, unnest([0, 0, -1, 1]) AS dy) s, cell c WHERE c.page = o.page AND c.x = o.x + dx AND c.y = o.y + dy),
in_ AS MATERIALIZED (SELECT * FROM cell EXCEPT SELECT * FROM outer_), reach AS (SELECT page, x, y, y * 60 + x AS far FROM in_ UNION SELECT r.page, r.x, r.y, c.y * 60 + c.x FROM reach r, (SELECT unnest([-1, 1, 0, 0]) AS dx, unnest([0, 0, -1, 1]) AS dy) s, in_ c WHERE c.page = r.page AND c.x = far % 60 + dx AND c.y = far // 60 + dy),
least AS (SELECT page, x, y, min(far) AS region FROM reach GROUP BY ALL) SELECT page, region, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM least GROUP BY page, region""")
def enclosed_regions(spark: SparkSession, d: str) -> DataFrame:
    """What the outlines of boxes enclose, by pages."""
    rows = table(spark, d, "lineitem").where("l_linenumber = 1").selectExpr("l_orderkey % 300 as page", "l_partkey * 37 % 57 as x0", "l_orderkey * 53 % 37 as y0", "l_partkey * 37 % 57 + 2 + l_linenumber as x1", "l_orderkey * 53 % 37 + 2 + cast(l_quantity as bigint) % 5 as y1")
    cells = rows.selectExpr("*", "explode(sequence(x0, x1)) as x").selectExpr("*", "explode(sequence(y0, y1)) as y").where("x in (x0, x1) or y in (y0, y1)")
    frames = rows.selectExpr("page", "60 as width", "40 as height").distinct()
    return raster.regions(cells, frames, tile=16)


@query("overlap_samples", "WITH o AS (SELECT DISTINCT trim(c_mktsegment) AS v FROM customer), n AS (SELECT DISTINCT trim(o_orderpriority) AS v FROM orders) SELECT 'value' AS column, (SELECT array_to_string(list(v ORDER BY v)[:3], '|') FROM (SELECT v FROM o EXCEPT SELECT v FROM n)) AS only_old, (SELECT array_to_string(list(v ORDER BY v)[:3], '|') FROM (SELECT v FROM n EXCEPT SELECT v FROM o)) AS only_new")
def overlap_samples(spark: SparkSession, d: str) -> DataFrame:
    found = joins.overlap_samples(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "value"), table(spark, d, "orders").withColumnRenamed("o_orderpriority", "value"), ["value"], 3)
    return found.select("column", *[F.array_join(c, "|").alias(c) for c in ("only_old", "only_new")])


@query("page_with_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    return relations.page_with_total(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50, 25)


@query("token_rows", "SELECT s_suppkey, s_name, n_nationkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 1")
def token_rows(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers with the nation whose word is among theirs; nations of one region have none."""
    left = table(spark, d, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("N"), "s_nationkey", F.lit(" S"), F.col("s_suppkey") % 7).alias("words"))
    right = table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") != 1, F.concat(F.lit("n"), "n_nationkey")).alias("word"))
    return joins.token_rows(left, right, "s_suppkey", "n_nationkey", "words", "word").select("s_suppkey", "s_name", "n_nationkey", "n_name")


_TEMPLATES = {"rise": [1.0, 2.0, 3.0, 4.0], "peak": [0.0, 3.0, 0.0], "dip": [2.0, 0.0, 0.0, 2.0]}


def _score_sql(t: list[float]) -> str:
    x = [f"lead(o_totalprice, {k}) OVER w" for k in range(len(t))]
    total, square, dot = "0.0 + " + " + ".join(x), "0.0 + " + " + ".join(f"{c} * ({c})" for c in x), "0.0 + " + " + ".join(f"{c} * {w}" for c, w in zip(x, t, strict=True))
    n, own = len(t), len(t) * sum(w * w for w in t) - sum(t) ** 2
    return f"({n} * ({dot}) - ({total}) * {sum(t)}) / nullif(sqrt(greatest(0.0, {n} * ({square}) - ({total}) * ({total})) * {own}), 0)"


@query("template_scores", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT o_custkey, o_orderkey, '{name}' AS template, round({_score_sql(t)}, 6) AS score FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)" for name, t in _TEMPLATES.items()) + ") WHERE score IS NOT NULL")
def template_scores(spark: SparkSession, d: str) -> DataFrame:
    """How a customer's orders from each one on look like a rise, a peak or a dip in price."""
    return series.template_scores(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice", _TEMPLATES, ["o_orderkey"]).withColumn("score", F.round("score", 6))


@query("running_means", """WITH RECURSIVE v AS (SELECT l_partkey, l_orderkey * 53 % 4000 AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 53 % 4000) AS k FROM lineitem), r AS (
  SELECT l_partkey, k, v::DOUBLE AS s, 1 AS n, v AS lo, v AS hi, 1 AS cluster FROM v WHERE k = 1 UNION ALL
  SELECT r.l_partkey, v.k, CASE WHEN v.v - r.s / r.n <= 60 THEN r.s + v.v ELSE v.v END, CASE WHEN v.v - r.s / r.n <= 60 THEN r.n + 1 ELSE 1 END, CASE WHEN v.v - r.s / r.n <= 60 THEN r.lo ELSE v.v END, v.v, CASE WHEN v.v - r.s / r.n <= 60 THEN r.cluster ELSE r.cluster + 1 END
  FROM r JOIN v ON v.l_partkey = r.l_partkey AND v.k = r.k + 1)
SELECT l_partkey, round(arg_max(s / n, k), 6) AS centre, max(n)::BIGINT AS n, min(lo)::DOUBLE AS lo, max(hi)::DOUBLE AS hi FROM r GROUP BY l_partkey, cluster""")
def running_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_partkey", "l_orderkey * 53 % 4000 as v")
    return series.running_means(rows, ["l_partkey"], "v", 60.0).withColumn("centre", F.round("centre", 6))


_WAYS = "SELECT DISTINCT l_partkey * 2 AS u, l_suppkey * 2 + 1 AS v, l_returnflag AS kind FROM lineitem"


@query("traced_paths", f"""WITH e AS ({_WAYS}), g AS MATERIALIZED (SELECT u AS a, v AS b, kind FROM e UNION SELECT v, u, kind FROM e), s AS MATERIALIZED (SELECT p_partkey * 2 AS node FROM part WHERE p_size > 12),
r0 AS (SELECT s_suppkey * 2 + 1 AS start, s_suppkey * 2 + 1 AS node FROM supplier WHERE s_suppkey % 10 = 0),
r1 AS MATERIALIZED (SELECT start, b AS node, min((a, kind)) AS best FROM r0 JOIN g ON a = node WHERE b <> start GROUP BY start, b),
r2 AS MATERIALIZED (SELECT start, b AS node, min((a, kind)) AS best FROM r1 JOIN g ON a = node WHERE node NOT IN (SELECT node FROM s) AND (start, b) NOT IN (SELECT start, node FROM r0 UNION ALL SELECT start, node FROM r1) GROUP BY start, b)
SELECT start, node, 0 AS hops, NULL AS parent, NULL AS kind, node IN (SELECT node FROM s) AS stops FROM r0 UNION ALL SELECT start, node, 1, struct_extract(best, 1), struct_extract(best, 2), node IN (SELECT node FROM s) FROM r1 UNION ALL SELECT start, node, 2, struct_extract(best, 1), struct_extract(best, 2), node IN (SELECT node FROM s) FROM r2""")
def traced_paths(spark: SparkSession, d: str) -> DataFrame:
    """From suppliers along lines to parts and on to suppliers, but not past large parts."""
    edges = table(spark, d, "lineitem").selectExpr("l_partkey * 2 as u", "l_suppkey * 2 + 1 as v", "l_returnflag as kind")
    start = table(spark, d, "supplier").where("s_suppkey % 10 = 0").selectExpr("s_suppkey * 2 + 1 as start")
    return graph.traced(edges, start, table(spark, d, "part").where("p_size > 12").selectExpr("p_partkey * 2 as node"), 2)


_SETS = "SELECT l_orderkey AS id, (l_partkey * 37 % 200)::DOUBLE AS x, (l_suppkey * 53 % 100)::DOUBLE AS y FROM lineitem"
_HU = f"""m AS (SELECT id, count(*) AS n, avg(x) AS a, avg(y) AS b FROM ({_SETS}) GROUP BY id), d AS (SELECT id, x - a AS x, y - b AS y, n FROM ({_SETS}) JOIN m USING (id)),
q AS (SELECT id, any_value(n) AS n, avg(x * x) AS c20, avg(y * y) AS c02, avg(x * y) AS c11, avg(x * x * x) AS c30, avg(y * y * y) AS c03, avg(x * x * y) AS c21, avg(x * y * y) AS c12, avg(x * x + y * y) AS s FROM d GROUP BY id),
c AS (SELECT id, n, c20 / s AS c20, c02 / s AS c02, c11 / s AS c11, c30 / s ** 1.5 AS c30, c03 / s ** 1.5 AS c03, c21 / s ** 1.5 AS c21, c12 / s ** 1.5 AS c12 FROM q WHERE s > 0),
h AS (SELECT id, n, (c20 - c02) ** 2 + 4 * c11 ** 2 AS h2, (c30 - 3 * c12) ** 2 + (3 * c21 - c03) ** 2 AS h3, (c30 + c12) ** 2 + (c21 + c03) ** 2 AS h4 FROM c)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey as id", "cast(l_partkey * 37 % 200 as double) as x", "cast(l_suppkey * 53 % 100 as double) as y")


@query("moment_invariants", f"WITH {_HU} SELECT id, n, round(h2, 5) AS h2, round(h3, 5) AS h3, round(h4, 5) AS h4 FROM h")
def moment_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of the places of an order's lines."""
    found = signatures.moment_invariants(_sets(spark, d), "id")
    return found.select("id", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("h2", "h3", "h4")])


# a thousandth and a half keeps rounded values off the limit
@query("near_signatures", f"WITH {_HU}, g AS (SELECT id, round(h2, 3) AS h2, round(h3, 3) AS h3, round(h4, 3) AS h4 FROM h WHERE n >= 4) SELECT a.id AS a, b.id AS b, round(greatest(abs(a.h2 - b.h2), abs(a.h3 - b.h3), abs(a.h4 - b.h4)), 6) AS gap FROM g a JOIN g b ON a.id < b.id AND abs(a.h2 - b.h2) <= 0.0035 AND abs(a.h3 - b.h3) <= 0.0035 AND abs(a.h4 - b.h4) <= 0.0035")
def near_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Orders of four lines and more whose places look alike."""
    found = signatures.moment_invariants(_sets(spark, d), "id").where("n >= 4").select("id", *[F.round(c, 3).alias(c) for c in ("h2", "h3", "h4")])
    found = save(found, "signatures")
    return signatures.near_vectors(found, found, "id", ["h2", "h3", "h4"], 0.0035).where("a < b").withColumn("gap", F.round("gap", 6))
