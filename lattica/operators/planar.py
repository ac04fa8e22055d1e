"""Graphs of segments that run along an axis: cut where others' ends lie on them, and parted into nets.

Defined cases: segments with a null or non-finite coordinate, on a null page or along no axis are left out; ids are unique on a page; segments of no
length are a node without a piece; overlapping ones are cut at each other's ends; an empty table gives an empty result; other columns are not read.
Segments in the same place are cut alike, so each place is cut once and its segments take what it has. A segment's cuts are sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import boxes as bx
from lattica.operators.geometry import BOX, _pairs, _proper
from lattica.operators.graph import components
from lattica.sources.shared import in_order, look_up, save


def _cut(segments: DataFrame, cell: float, size: float) -> tuple[DataFrame, DataFrame]:
    """page, id and BOX of the segments, and page, BOX, id (the least), piece, u, v of each place that segments take."""
    along = (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    flat = segments.where(along & F.col("page").isNotNull()).select("page", "id", *[F.col(c).cast("double").alias(c) for c in BOX])
    flat = flat.select("page", "id", *[F.least(f"{c}0", f"{c}1").alias(f"{c}0") for c in "xy"], *[F.greatest(f"{c}0", f"{c}1").alias(f"{c}1") for c in "xy"])
    flat = save(_proper(flat), "segments")
    shapes = save(flat.groupBy("page", *BOX).agg(F.min("id").alias("id")), "shapes")
    both = F.explode(F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)])).alias("p")
    # ends in the same place cut alike, so a place is one point, however many ends it has
    places = shapes.select("page", both).select(F.lit(0).alias("id"), "page", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1")).distinct()
    places = save(places, "places")
    # pairs come with the coordinates of both, so neither places nor segments are looked up again
    on = lambda c: F.least(F.greatest(F.col(f"a_{c}0"), F.col(f"b_{c}0")), F.col(f"b_{c}1"))
    cuts = _pairs(places, shapes, cell, size / 2).select("page", *[F.col(f"b_{c}").alias(c) for c in ("id", *BOX)], bx.grid_key(F.col("a_x0"), F.col("a_y0"), size).alias("u"), (on("x") - F.col("b_x0") + on("y") - F.col("b_y0")).alias("at"))
    # of the cuts that are one node the first counts; dealt by place once, for this and for their order
    cuts = cuts.repartition("page", *BOX).groupBy("page", *BOX, "id", "u").agg(F.min("at").alias("at"))
    order = Window.partitionBy("page", *BOX).orderBy("at", "u")
    return flat, cuts.select("page", *BOX, "id", F.row_number().over(order).alias("piece"), "u", F.lead("u").over(order).alias("v")).where("v is not null")


def pieces(segments: DataFrame, cell: float, size: float) -> DataFrame:
    """page, id, piece (from 1), u, v: what segments (id, page, x0, y0, x1, y1) are cut into where ends lie on them or miss by `size` / 2 at most. u and v are keys of
    nodes: places that round to the same multiples of `size`. cell: about the length of a usual segment."""
    flat, cut = _cut(segments, cell, size)
    # sorted once, whatever the join does with it
    cut = save(cut.drop("id"), "cut")
    return flat.join(cut, ["page", *BOX]).select("page", "id", "piece", "u", "v")


def _edge_nets(cut: DataFrame, barriers: DataFrame, size: float) -> DataFrame:
    """page, u, v and `net` of the edges that pieces run along: the least id that is connected without passing a barrier; null between two barriers, where each
    piece is alone."""
    stop = barriers.where("x is not null and y is not null").select("page", bx.grid_key(F.col("x").cast("double"), F.col("y").cast("double"), size).alias("node")).distinct().withColumn("stops", F.lit(True))
    stop = save(stop, "stops")
    edges = cut.groupBy("page", "u", "v").agg(F.min("id").alias("least"))
    # a barrier joins nothing, so it is no node
    for side in "uv":
        marked = look_up(edges, stop.withColumnsRenamed({"node": side, "stops": f"{side}_stops"}), ["page", side], "left")
        edges = marked.withColumn(f"{side}_node", F.when(F.col(f"{side}_stops").isNull(), F.col(side))).drop(f"{side}_stops")
    edges = save(edges, "edges")
    nodes = edges.select("page", F.explode(F.array("u_node", "v_node")).alias("node")).where("node is not null").distinct()
    numbered = save(in_order(nodes, ["page", "node"], "number"), "numbered")
    for side in "uv":
        edges = edges.join(numbered.withColumnsRenamed({"node": f"{side}_node", "number": f"{side}_number"}), ["page", f"{side}_node"], "left")
    edges = save(edges.select("page", "u", "v", "least", "u_number", "v_number"), "numbers")
    root = components(edges.select(F.col("u_number").alias("u"), F.col("v_number").alias("v")))
    one = F.coalesce("u_number", "v_number")
    rooted = save(edges.withColumn("node", one).join(root, "node", "left").select("page", "u", "v", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = save(rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("net")), "least")
    return rooted.join(least, "root", "left").select("page", "u", "v", "net")


def nets(cut: DataFrame, barriers: DataFrame, size: float) -> DataFrame:
    """cut (page, id, piece, u, v) and `net`: the least id of the segments that are connected without passing a barrier (points page, x, y). Pieces that meet
    only at a barrier are in nets of their own; a barrier's node is in each of them. Pieces between the same nodes are one edge. A hub's edges meet as rows of saved tables."""
    return cut.join(save(_edge_nets(cut, barriers, size), "nets"), ["page", "u", "v"]).select(*cut.columns, F.coalesce("net", "id").alias("net"))


def netted(segments: DataFrame, barriers: DataFrame, cell: float, size: float) -> DataFrame:
    """nets() of pieces() of segments: nets are told for the places that segments take, not for each segment."""
    flat, cut = _cut(segments, cell, size)
    cut = save(cut, "cut")
    known = save(cut.join(_edge_nets(cut, barriers, size), ["page", "u", "v"]).select("page", *BOX, "piece", "u", "v", "net"), "known")
    return flat.join(known, ["page", *BOX]).select("page", "id", "piece", "u", "v", F.coalesce("net", "id").alias("net"))
