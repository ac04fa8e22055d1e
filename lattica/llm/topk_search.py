"""Exact top-k search by dual cover trees.

At most `CENTRES` candidates, taken by hash, are the centres of a top-level net. Every candidate belongs to the cell of its nearest centre; a
cell's rows are dealt to shards of bounded size. A query first visits one shard of its best cell, which gives it k scores to beat; then it
visits the other shards, but for the cells that can't reach its kth score: no score in a cell exceeds q.c + |q| r for its centre c and radius r.
Visits to a shard are dealt to blocks of bounded size. In each group of a block and a shard a cover tree indexes the shard and another the
block, and pairs of nodes are visited together: the score of any query and candidate below a pair is at most c.d + r|d| + s|c| + rs for centres
c, d and covering radii r, s, and a pair is pruned if that is less than the worst kth score among the queries of its query node. The k best
of each group meet in a window that keeps k rows of a query per task before the shuffle. `pairs_scored` tells how much was pruned.

Defined cases: vectors that are null, empty, hold null or non-finite components (also after scaling), or have a null id, take no part;
vectors with a component beyond 2**20 after scaling, whose scores may not be exact in doubles, are scored in whole numbers of any length
against all others, without a tree; scores beyond a long's range count as its end; only vectors of the same length score against each other;
rows with the query's id are its own; a query given twice (same id and vector) asks once; rows with the same id and other vectors ask each;
other repeated rows are candidates each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import look_up, save, table

K, EVERY, SCALE = 20, 20, 64
SHARD, BLOCK, LEAF, CENTRES = 16384, 8192, 128, 512
EXACT = 1 << 20
NET = 256  # possible centres whose distances are computed at once


class CoverTree:
    """Rows in tree order, and for each node its range of rows, centre, covering radius and children.

    A node whose points lie within 2**level of its centre is split into children within 2**(level - 1) of centres that are farther apart than
    that; the first child keeps the parent's centre. Small children of one node share a leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.empty(len(x), np.int64)
        self.begin, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        self._next = 0
        if len(x):
            self._build(x, np.arange(len(x)), leaf)
        self.x = x[self.order]
        self.norm = np.array([float(np.sqrt(c @ c)) for c in self.centre])

    def _node(self, centre: np.ndarray, radius: float) -> int:
        self.begin.append(self._next)
        self.end.append(self._next)
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        return len(self.begin) - 1

    def _build(self, x: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        top, todo, square = None, [(rows, -1)], (x * x).sum(1)
        while todo:
            rows, above = todo.pop()
            if above <= -2:  # all below this node are placed
                self.end[-above - 2] = self._next
                continue
            # whole numbers, so squared distances by products are exact
            distance2 = square[rows] + square[rows[0]] - 2 * (x[rows] @ x[rows[0]])
            radius = math.sqrt(max(0.0, distance2.max()))
            node = self._node(x[rows[0]], radius)
            if above >= 0:
                self.children[above].append(node)
            top = node if top is None else top
            if len(rows) <= leaf or radius == 0:
                self.order[self._next : self._next + len(rows)] = rows
                self._next += len(rows)
                self.end[node] = self._next
                continue
            reach = 2.0 ** (math.ceil(math.log2(radius)) - 1)
            near = distance2 <= reach * reach
            groups, small = [rows[near]], []
            rows = rows[~near]
            own, left = x[rows], np.ones(len(rows), bool)
            for at in range(0, len(rows), NET):
                block = at + np.flatnonzero(left[at : at + NET])
                within = square[rows[block]][:, None] + square[rows] - 2 * (own[block] @ own.T) <= reach * reach
                for k, near in zip(block.tolist(), within, strict=True):
                    if left[k]:  # farther than that from all centres so far: the next one, and the first of its members
                        member = np.flatnonzero(near & left)
                        left[member] = False
                        (groups if len(member) > leaf // 4 else small).append(rows[member])
            bucket: list[np.ndarray] = []
            for member in small:
                bucket.append(member)
                if sum(map(len, bucket)) >= leaf:
                    groups.append(np.concatenate(bucket))
                    bucket = []
            if bucket:
                groups.append(np.concatenate(bucket))
            todo.append((rows, -node - 2))
            todo += [(g, node) for g in groups if len(g)]
        return top


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best ids and scores of each query, best first, -inf where there are fewer, and how many pairs were scored. floor: scores that k
    other candidates are known to reach; what is below may be left out."""
    q, p = CoverTree(queries, leaf), CoverTree(points, leaf)
    floor = np.full(len(queries), -np.inf) if floor is None else floor[q.order]
    scored = 0
    own, ids = query_ids[q.order], ids[p.order]
    best, who = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    todo = [(0, 0, np.inf)] if len(queries) and len(points) else []
    q_centre, p_centre, p_radius = np.array(q.centre), np.array(p.centre), np.array(p.radius)
    while todo:
        a, b, bound = todo.pop()
        rows = slice(q.begin[a], q.end[a])
        worst = np.maximum(best[rows, -1], floor[rows])
        if bound < worst.min():
            continue
        if not q.children[a] and not p.children[b]:
            columns = slice(p.begin[b], p.end[b])
            score = q.x[rows] @ p.x[columns].T
            scored += score.size
            score[own[rows][:, None] == ids[columns]] = -np.inf
            # what reaches a query's kth score so far is sorted in with its k best
            row, column = np.nonzero((score >= worst[:, None]) & (score > -np.inf))
            if not len(row):
                continue
            some, row = np.unique(row, return_inverse=True)
            at, n = some + q.begin[a], np.bincount(row) + k
            row = np.concatenate([np.repeat(np.arange(len(some)), k), row])
            value = np.concatenate([best[at].ravel(), score[some[row[len(some) * k :]], column]])
            name = np.concatenate([who[at].ravel(), ids[columns][column]])
            pick = np.lexsort((name, -value, row))[(np.cumsum(n) - n)[:, None] + np.arange(k)]
            best[at], who[at] = value[pick], name[pick]
            continue
        # the wider node is split; the most promising pair is visited first
        if q.children[a] and (not p.children[b] or q.radius[a] > p.radius[b]):
            pairs = np.array([(c, b) for c in q.children[a]])
        else:
            pairs = np.array([(a, c) for c in p.children[b]])
        r, s = np.array(q.radius)[pairs[:, 0]], p_radius[pairs[:, 1]]
        bounds = (q_centre[pairs[:, 0]] * p_centre[pairs[:, 1]]).sum(1) + r * p.norm[pairs[:, 1]] + s * q.norm[pairs[:, 0]] + r * s
        bounds += 1e-9 * np.abs(bounds) + 1e-6
        for n in np.argsort(bounds).tolist():
            todo.append((int(pairs[n, 0]), int(pairs[n, 1]), float(bounds[n])))
    out, names = np.empty_like(best), np.empty_like(who)
    out[q.order], names[q.order] = best, who
    return names, out, scored


def exact_search(queries: list, query_ids: np.ndarray, points: list, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's place, id, score) of the k best, in whole numbers of any length."""
    whole = lambda rows: np.array([[int(x) for x in v] for v in rows], object)
    p, out = whole(points), []
    for n, q in enumerate(queries):
        scores = p @ whole([q])[0]
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != query_ids[n])[:k]
        out += [(n, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, i in best]
    return out


def vectors(table: DataFrame, scale: float = SCALE) -> DataFrame:
    """id, v (array of doubles, whole numbers), dim, wide (whether a component is beyond EXACT)."""
    scaled = F.transform(table["embedding"], lambda x: x.cast("double") * scale)
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = table.where(table["vec_id"].isNotNull() & table["embedding"].isNotNull() & (F.size(table["embedding"]) > 0) & fine)
    # floor() gives longs; beyond their range doubles are whole numbers
    v = F.transform(scaled, lambda x: F.when(F.abs(x) < 1 << 53, F.floor(x).cast("double")).otherwise(x))
    return some.select(table["vec_id"].cast("long").alias("id"), v.alias("v"), F.size(table["embedding"]).alias("dim"), F.exists(scaled, lambda x: F.abs(x) > EXACT).alias("wide"))


_FOUND = "row long, query_id long, vec_id long, score long, scored long"


def _answer(q: pd.DataFrame, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, scored: int) -> pd.DataFrame:
    """A group's best rows, and a row that tells how many pairs were scored."""
    out = pd.DataFrame({"row": q["row"].to_numpy()[who], "query_id": q["id"].to_numpy()[who], "vec_id": ids, "score": scores}).astype("int64").astype("object").assign(scored=None)
    return pd.concat([out, pd.DataFrame([[None, None, None, None, scored]], columns=out.columns, dtype="object")])


def _visited(visits: DataFrame, placed: DataFrame, k: int, block: int) -> DataFrame:
    """_FOUND for what the visits (row, id, v, floor and the shard's dim, cell, part) find among placed candidates (id, v, dim, cell, part)."""
    shard = ["dim", "cell", "part"]
    blocks = save(visits.groupBy(*shard).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    left = look_up(visits, blocks, shard).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    right = look_up(placed, blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def of_group(key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return _answer(q, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0)
        names, scores, scored = search(np.stack(q["v"]), q["id"].to_numpy(), np.stack(p["v"]), p["id"].to_numpy(), k, q["floor"].to_numpy())
        who, at = np.nonzero(np.isfinite(scores))
        return _answer(q, who, names[who, at], scores[who, at], scored)

    return left.groupBy(*shard, "block").cogroup(right.groupBy(*shard, "block")).applyInPandas(of_group, _FOUND)


def _exact(asked: DataFrame, rows: DataFrame, k: int, shard: int, block: int) -> DataFrame:
    """_FOUND for all queries against all rows, in whole numbers of any length."""
    parts, blocks = (max(1, math.ceil(df.count() / most)) for df, most in ((rows, shard), (asked, block)))
    left = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def of_group(key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = exact_search(q["v"].tolist(), q["id"].to_numpy(), p["v"].tolist(), p["id"].to_numpy(), k) if len(q) and len(p) else []
        return _answer(q, np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64), len(q) * len(p))

    keys = ["dim", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(of_group, _FOUND)


def _cells(rows: DataFrame, asked: DataFrame, shard: int, centres: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with their cell and part, the cells (dim, cell, parts), and asked with the best cell (seed) and bounds, an array by cell. Cell -1 holds
    rows of a length that no centre has; it has no bound."""
    wanted = min(centres, math.ceil(rows.count() / shard))
    found = rows.orderBy(F.xxhash64("row"), "row").limit(wanted).select("dim", "v").collect()  # at most `centres` rows
    net = {d: (np.array([k for k, r in enumerate(found) if r.dim == d]), np.array([r.v for r in found if r.dim == d])) for d in {r.dim for r in found}}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, gap = np.full(len(pdf), -1, np.int32), np.full(len(pdf), np.inf)
            for d, (own, c) in net.items():
                at = np.flatnonzero(pdf["dim"] == d)
                if len(at):
                    x = np.stack(pdf["v"].iloc[at])
                    square = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)
                    best = square.argmin(1)
                    cell[at], gap[at] = own[best], np.sqrt(square[np.arange(len(at)), best])
            yield pdf.assign(cell=cell, gap=gap)

    placed = save(rows.mapInPandas(nearest, "id long, v array<double>, dim int, row long, cell int, gap double"), "placed")
    cells = save(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"), F.max("gap").alias("radius")), "cells")
    radius = {r.cell: r.radius for r in cells.where("cell >= 0").collect()}  # at most `centres` rows

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bounds, seed = [[]] * len(pdf), np.full(len(pdf), -1, np.int32)
            for d, (own, c) in net.items():
                at = np.flatnonzero(pdf["dim"] == d)
                if len(at):
                    x = np.stack(pdf["v"].iloc[at])
                    near = x @ c.T
                    seed[at] = own[near.argmax(1)]
                    most = np.full((len(at), len(found)), -np.inf)
                    most[:, own] = near + np.sqrt((x * x).sum(1))[:, None] * np.array([radius.get(k, 0.0) for k in own.tolist()])
                    most += 1e-9 * np.abs(most, where=np.isfinite(most), out=np.zeros_like(most)) + 1e-6
                    for n, m in zip(at, most, strict=True):
                        bounds[n] = m
            yield pdf.assign(seed=seed, bounds=bounds)

    asked = save(asked.mapInPandas(bounded, "id long, v array<double>, dim int, row long, seed int, bounds array<double>"), "asked")
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int").alias("part")
    return look_up(placed, cells, ["dim", "cell"]).select("id", "v", "dim", "cell", part), cells.drop("radius"), asked


def _searched(queries: DataFrame, candidates: DataFrame, k: int, shard: int, block: int, centres: int) -> tuple[DataFrame, DataFrame]:
    """_FOUND, and the number of all pairs."""
    rows = save(candidates.withColumn("row", F.monotonically_increasing_id()), "candidates")
    asked = save(queries.dropDuplicates(["id", "v"]).withColumn("row", F.monotonically_increasing_id()), "queries")
    pairs = asked.groupBy("dim").agg(F.count("*").alias("q")).join(rows.groupBy("dim").agg(F.count("*").alias("n")), "dim").agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("pairs"))
    wide_rows, wide_asked = rows.where("wide").drop("wide"), asked.where("wide").drop("wide")
    narrow_asked = asked.where("not wide").drop("wide")
    placed, cells, seeded = _cells(rows.where("not wide").drop("wide"), narrow_asked, shard, centres)
    own = F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts")).cast("int")
    visit = ["row", "id", "v", "dim", "cell", "part", "floor"]
    first = look_up(seeded.withColumn("cell", F.col("seed")), cells, ["dim", "cell"]).withColumn("part", own).withColumn("floor", F.lit(float("-inf"))).select(*visit)
    found = save(_visited(first, placed, k, block), "found")
    floor = found.where("vec_id is not null").groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    # the cells of the query's length that can reach its kth score so far, but for the shard that it has visited
    known = save(seeded.join(floor, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")
    open_cells = look_up(known, cells, ["dim"]).where((F.col("cell") < 0) | (F.get("bounds", F.greatest("cell", F.lit(0))) >= F.col("floor")))
    rest = open_cells.withColumn("seen", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where((F.col("cell") != F.col("seed")) | (F.col("part") != F.col("seen")))
    found = found.unionByName(_visited(rest.select(*visit), placed, k, block))
    if wide_rows.limit(1).count() or wide_asked.limit(1).count():
        found = found.unionByName(_exact(wide_asked, rows.drop("wide"), k, shard, block)).unionByName(_exact(narrow_asked, wide_rows, k, shard, block))
    return found, pairs


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: id, v, dim, wide."""
    found, _ = _searched(queries, candidates, k, shard, block, centres)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.where("vec_id is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pairs_scored(queries: DataFrame, candidates: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """One row: how many pairs the search scores, and how many there are."""
    found, pairs = _searched(queries, candidates, k, shard, block, centres)
    return found.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")).crossJoin(pairs)


def op4_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(every.where(F.col("id") % EVERY == 0), every)


QUERIES = {"op4_cover_tree_topk": op4_cover_tree_topk}
ORACLE_SQL = {
    "op4_cover_tree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0) q JOIN v p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
) WHERE rank <= 20
"""
}
