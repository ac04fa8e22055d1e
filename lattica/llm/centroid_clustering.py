"""Centroid clustering of integer vectors in exact arithmetic, with Hamerly's bounds.

Each vector keeps, in a table that every round writes anew, its cluster, an upper bound on the distance to its own centroid and one lower bound
on the distance to any other. When centroids move, the upper bound grows by how far its own centroid went and the lower one falls by how far
any other did. A vector whose upper bound lies below its lower one, or below half the way from its centroid to the nearest other, stays where
it is without a distance computed; else the distance to its own centroid is computed, and if that does not settle it, a full scan of all
centroids in whole numbers decides. Bounds are widened by more than doubles can round, so they never decide what a scan would not.

Centroids (k x components) are all that tasks are sent. Sums of clusters are made in each task and meet as k rows of sums a task.

Defined cases: vectors that are null, have another number of components or hold nulls, NaN or infinities are left out; ties go to the smaller
centroid; an empty centroid stays; fewer vectors than centroids make as many centroids as there are vectors; a null vec_id is clustered but
comes last among the first centroids; equal ids are told apart by their components there; repeated rows count each; an empty table gives an
empty result; other columns are not read. A component beyond 2**27 in size after scaling raises an error: distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import save, table

CENTROIDS, ROUNDS, COMPONENTS, SCALE, MOST = 40, 5, 64, 256, 1 << 27
#: Relative width that bounds get beyond their value; doubles round by 2**-53 a step.
SLACK = 1e-9
_STATE = "vec_id long, v binary, cluster int, upper double, lower double, n_scans int"


def kept_vectors(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<long>): floor(scale * x) of the vectors that take part."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is not less
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)))
    rows = df.where((F.size("embedding") == components) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    too_large = F.exists("v", lambda x: F.abs(x) > MOST)
    return rows.withColumn("v", F.when(too_large, F.raise_error(F.lit(f"a component is beyond {MOST}"))).otherwise(F.col("v")))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, salt: str = "2") -> np.ndarray:
    """The k vectors with the least hashes. Spark keeps k rows of a task."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(key.asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in found], np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances. Doubles hold whole numbers up to 2**53, so small components may use the faster product."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    dot = (x.astype(float) @ c.T.astype(float)).astype(np.int64) if most * most * x.shape[1] < 1 << 52 else x @ c.T
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * dot


def assigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, moved: np.ndarray) -> tuple:
    """cluster, upper, lower after the centroids c have moved that far, and which vectors were scanned."""
    if len(c) == 1:
        other, half = np.zeros(1), np.full(1, np.inf)
    else:
        far = np.argsort(moved)[-2:]
        other = np.where(np.arange(len(c)) == far[1], moved[far[0]], moved[far[1]])
        between = _squares(c, c).astype(float)
        np.fill_diagonal(between, np.inf)
        half = np.sqrt(between.min(1)) / 2 * (1 - SLACK)
    new = cluster < 0
    own = np.where(new, 0, cluster)
    upper = np.where(new, np.inf, (upper + moved[own]) * (1 + SLACK))
    lower = np.where(new, -np.inf, np.maximum(0, lower - other[own]) * (1 - SLACK))
    limit = np.maximum(lower, half[own])
    unsure = np.flatnonzero(~(upper < limit) & ~new)
    if len(unsure):
        gap = x[unsure] - c[own[unsure]]
        upper[unsure] = np.sqrt((gap * gap).sum(1).astype(float)) * (1 + SLACK)
    scan = ~(upper < limit)
    at = np.flatnonzero(scan)
    if len(at):
        square = _squares(x[at], c)
        best = square.argmin(1)  # the first of equals
        own[at] = best
        upper[at] = np.sqrt(square[np.arange(len(at)), best].astype(float)) * (1 + SLACK)
        square[np.arange(len(at)), best] = np.iinfo(np.int64).max
        lower[at] = np.sqrt(square.min(1).astype(float)) * (1 - SLACK) if len(c) > 1 else np.inf
    return own, upper, lower, scan


def _arrays(batch: pa.RecordBatch, components: int) -> np.ndarray:
    """Vectors of a batch; each is stored in the width that its own components need."""
    out = np.empty((batch.num_rows, components), np.int64)
    for k, b in enumerate(batch.column("v").to_pylist()):
        out[k] = np.frombuffer(b, np.int16 if len(b) == 2 * components else np.int32)
    return out


def _packed(rows: DataFrame) -> DataFrame:
    """The state before the first round: no cluster, bounds that decide nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for v in b.column("v").to_pylist():
                a = np.array(v, np.int32)
                packed.append(a.tobytes() if np.abs(a).max() > 32767 else a.astype(np.int16).tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed, pa.binary()), pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32))], names=["vec_id", "v", "cluster", "upper", "lower", "n_scans"])

    return rows.mapInArrow(run, _STATE)


def _step(state: DataFrame, c: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after every vector went to its nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            num = lambda name: b.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            own, upper, lower, scan = assigned(_arrays(b, c.shape[1]), num("cluster"), num("upper"), num("lower"), c, moved)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array((num("n_scans") + scan).astype(np.int32))], names=["vec_id", "v", "cluster", "upper", "lower", "n_scans"])

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, components: int) -> tuple[np.ndarray, list[list[int]]]:
    """How many vectors each cluster has and their sums: at most k rows of each task meet, k rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, components), np.int64)
        for b in batches:
            own, x = b.column("cluster").to_numpy(), _arrays(b, components)
            order = np.argsort(own, kind="stable")
            at = np.flatnonzero(np.diff(own[order], prepend=-1))
            if len(at):
                total[own[order][at]] += np.add.reduceat(x[order], at, axis=0)
                n += np.bincount(own, minlength=k)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    each: list[Column] = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(components)]
    n, sums = np.zeros(k, np.int64), [[0] * components for _ in range(k)]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*each).alias("sums")).collect():
        n[r.cluster], sums[r.cluster] = r.n, [int(s) for s in r.sums]
    return n, sums


def clustered(rows: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The state (vec_id, v, cluster, upper, lower, n_scans) after `rounds` rounds of assigning and moving centroids and a last assignment, and the
    centroids. rows: of kept_vectors()."""
    c, moved = start.copy(), np.zeros(len(start))
    state = save(_packed(rows), "vectors")
    for _ in range(rounds):
        state = save(_step(state, c, moved), "state")
        n, sums = _sums(state, *c.shape)
        new = np.array([[s // int(n[j]) for s in sums[j]] if n[j] else c[j] for j in range(len(c))], np.int64)
        gap = new - c
        c, moved = new, np.sqrt((gap * gap).sum(1).astype(float)) * (1 + SLACK)
    return save(_step(state, c, moved), "state"), c


def with_distances(state: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared, exact), n_scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap = _arrays(b, c.shape[1]) - c[b.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array((gap * gap).sum(1)), b.column("n_scans")], names=["vec_id", "cluster", "distance", "n_scans"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long, n_scans int")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_vectors(table(spark, sf_dir, "embeddings"))
    start = first_centroids(rows)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, c = clustered(rows, start)
    out = with_distances(state, c)
    totals = {r.cluster: r.total for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row for each centroid
    final = spark.createDataFrame([(j, ",".join(map(str, c[j].tolist())), totals[j], sum(totals.values())) for j in sorted(totals)], "cluster int, at string, cluster_inertia long, inertia long")
    named = final.select("cluster", "cluster_inertia", "inertia", F.sha2("at", 256).alias("centroid_sha256"))
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same rounds in SQL, over components as rows."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
  SELECT row, j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{r} c USING (i) GROUP BY row, j
), a{r} AS MATERIALIZED (
  SELECT row, min_by(j, (distance, j)) AS j, min(distance) AS distance FROM d{r} GROUP BY row
)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.j, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT j, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{r} JOIN v USING (row) GROUP BY j, i
  ) m ON c.j = m.j AND c.i = m.i
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept
), first AS (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS j, v FROM kept QUALIFY j < {CENTROIDS}
), c0 AS MATERIALIZED (
  SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM first
), {", ".join(steps)}, names AS (
  SELECT j, sha256(string_agg(x::BIGINT, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j
)
SELECT vec_id, j AS cluster, distance, (sum(distance) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (row) JOIN names USING (j)
"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE_SQL = {"op13_centroid_clustering": _oracle()}
