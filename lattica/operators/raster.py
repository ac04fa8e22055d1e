"""Regions of rasters: cells that walls part from each other, found in tiles and joined along the tiles' borders.

Each tile is labelled in a task of its own (runs of open cells, joined from line to line by union-find). What leaves a tile is a row for each of its
parts and one for each open cell on its border; parts of neighbouring tiles that touch are edges of a graph whose components are the regions, so
neither a page nor a region is any single task's work.

Defined cases: walls with a null coordinate, outside their frame or on a page without one are left out; repeated walls count once; of several frames of
a page the largest width and height count; a null page has no regions; a frame of no size has none; no frames give an empty result; other
columns are not read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.graph import components
from lattica.sources.shared import in_order, look_up, save

TILE = 256


def labels(open_: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each open cell, the same for all that sides connect, from 0; -1 for walls; and how many numbers there are."""
    out = np.full(open_.shape, -1, np.int64)
    edge = np.diff(np.pad(open_, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = np.arange(len(row))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(row, np.arange(open_.shape[0] + 1))
    for y in range(1, open_.shape[0]):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if start[a] < end[b] and start[b] < end[a]:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    roots, number = np.unique([root(k) for k in range(len(row))], return_inverse=True)
    for k in range(len(row)):
        out[row[k], start[k] : end[k]] = number[k]
    return out, len(roots)


def _tile(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        page, tx, ty, width, height = pdf[["page", "tx", "ty", "width", "height"]].iloc[0].tolist()
        x0, y0 = tx * size, ty * size
        open_ = np.ones((min(size, height - y0), min(size, width - x0)), bool)
        walls = pdf[pdf["x"].notna()]
        open_[walls["y"].to_numpy(np.int64) - y0, walls["x"].to_numpy(np.int64) - x0] = False
        at, n = labels(open_)
        ys, xs = np.nonzero(open_)
        own, ys, xs = at[ys, xs], ys + y0, xs + x0
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, own, ys * width + xs)
        box = [np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.full(n, -1)]
        for k, (pick, v) in enumerate(((np.minimum, xs), (np.minimum, ys), (np.maximum, xs), (np.maximum, ys))):
            pick.at(box[k], own, v)
        parts = pd.DataFrame({"part": True, "label": first, "n": np.bincount(own, minlength=n), "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3]})
        side = (xs == x0) | (ys == y0) | (xs == x0 + open_.shape[1] - 1) | (ys == y0 + open_.shape[0] - 1)
        border = pd.DataFrame({"part": False, "label": first[own[side]], "n": 0, "x0": xs[side], "y0": ys[side], "x1": xs[side], "y1": ys[side]})
        return pd.concat([parts, border]).assign(page=page)[["page", "part", "label", "n", "x0", "y0", "x1", "y1"]]

    return run


def regions(walls: DataFrame, frames: DataFrame, tile: int = TILE, enclosed: bool = True) -> DataFrame:
    """page, region (the least y * width + x of its cells), n, x0, y0, x1, y1 of the regions of open cells in the frames (page, width, height) that
    walls (page, x, y) leave. enclosed: without those that reach the frame."""
    frames = frames.where("page is not null and width > 0 and height > 0").groupBy("page").agg(F.max("width").cast("long").alias("width"), F.max("height").cast("long").alias("height"))
    frames = save(frames, "frames")
    cells = walls.where("x is not null and y is not null").select("page", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    cells = look_up(cells, frames, ["page"]).where("x >= 0 and y >= 0 and x < width and y < height").select("page", "width", "height", "x", "y", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(c) - 1) / tile)))
    # a row for each tile, so that those without walls are labelled too
    every = frames.withColumn("tx", span("width")).withColumn("ty", span("height")).withColumns({c: F.lit(None).cast("long") for c in "xy"})
    number = [T.StructField(c, T.LongType()) for c in ("label", "n", "x0", "y0", "x1", "y1")]
    kind = T.StructType([frames.schema["page"], T.StructField("part", T.BooleanType()), *number])
    found = save(every.unionByName(cells).groupBy("page", "tx", "ty").applyInPandas(_tile(tile), kind), "tiles")
    parts = save(in_order(found.where("part"), ["page", "label"], "node"), "parts")
    border = found.where("not part").select("page", F.col("x0").alias("x"), F.col("y0").alias("y"), "label")
    # a cell in a tile's last column or line meets the next tile's first
    edge = lambda c, k: F.col(c) % tile == k
    touching = []
    for c, other in (("x", "y"), ("y", "x")):
        ahead = border.where(edge(c, tile - 1)).select("page", (F.col(c) + 1).alias(c), other, F.col("label").alias("lu"))
        touching.append(ahead.join(border.where(edge(c, 0)).withColumnRenamed("label", "lv"), ["page", "x", "y"]).select("page", "lu", "lv"))
    pairs = touching[0].unionByName(touching[1]).distinct()
    node = parts.select("page", "label", "node")
    pairs = pairs.join(node.toDF("page", "lu", "u"), ["page", "lu"]).join(node.toDF("page", "lv", "v"), ["page", "lv"])
    root = components(pairs.select("u", "v"))
    whole = parts.join(root.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").groupBy("page", F.coalesce("root", "node").alias("root"))
    out = whole.agg(F.min("label").alias("region"), F.sum("n").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    if enclosed:
        out = look_up(out, frames, ["page"]).where("x0 > 0 and y0 > 0 and x1 < width - 1 and y1 < height - 1")
    return out.select("page", "region", "n", "x0", "y0", "x1", "y1")
