"""Descriptors of point sets that moving, turning and scaling leave as they are, and the search for near ones.

Defined cases: points with a null or non-finite coordinate or a null set are left out; sets whose points all lie in one place have no descriptor; repeated points
count each; vectors with a null are near nothing; ids are unique; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ["h2", "h3", "h4", "h5", "h6"]


def moment_invariants(points: DataFrame, by: str) -> DataFrame:
    """by, n, h2 .. h6: Hu's moment invariants of each set of points (by, x, y), with the spread about the centre as unit; the first is 1 by that. Ten sums are
    all that meets, so a set with very many points is no single task's."""
    fine = (F.abs(F.col("x").cast("double")) < float("inf")) & (F.abs(F.col("y").cast("double")) < float("inf"))
    known = points.where(F.col(by).isNotNull() & fine).select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    power = lambda c, k: F.lit(1.0) if not k else F.col(c) if k == 1 else F.col(c) * F.col(c) if k == 2 else F.col(c) * F.col(c) * F.col(c)
    order = [(p, q) for p in range(4) for q in range(4 - p)]
    sums = known.groupBy(by).agg(*[F.avg(power("x", p) * power("y", q)).alias(f"m{p}{q}") for p, q in order[1:]], F.count("*").alias("n"))
    m = {(p, q): F.col(f"m{p}{q}") for p, q in order[1:]}
    a, b = m[1, 0], m[0, 1]
    c = {
        (2, 0): m[2, 0] - a * a, (0, 2): m[0, 2] - b * b, (1, 1): m[1, 1] - a * b,
        (3, 0): m[3, 0] - 3 * a * m[2, 0] + 2 * a * a * a, (0, 3): m[0, 3] - 3 * b * m[0, 2] + 2 * b * b * b,
        (2, 1): m[2, 1] - 2 * a * m[1, 1] - b * m[2, 0] + 2 * a * a * b, (1, 2): m[1, 2] - 2 * b * m[1, 1] - a * m[0, 2] + 2 * b * b * a,
    }
    spread = F.sqrt(c[2, 0] + c[0, 2])
    central = sums.where(c[2, 0] + c[0, 2] > 0).select(by, "n", *[(v / F.pow(spread, F.lit(float(p + q)))).alias(f"c{p}{q}") for (p, q), v in c.items()])
    c20, c02, c11, c30, c03, c21, c12 = (F.col(f"c{p}{q}") for p, q in c)
    u, v = c30 + c12, c21 + c03
    return central.select(
        by, "n", ((c20 - c02) * (c20 - c02) + 4 * c11 * c11).alias("h2"), ((c30 - 3 * c12) * (c30 - 3 * c12) + (3 * c21 - c03) * (3 * c21 - c03)).alias("h3"), (u * u + v * v).alias("h4"),
        ((c30 - 3 * c12) * u * (u * u - 3 * v * v) + (3 * c21 - c03) * v * (3 * u * u - v * v)).alias("h5"), ((c20 - c02) * (u * u - v * v) + 4 * c11 * u * v).alias("h6"),
    )


def near_vectors(left: DataFrame, right: DataFrame, key: str, columns: list[str], reach: float, banded: int = 2) -> DataFrame:
    """a, b, gap: all pairs of rows whose vectors (columns) differ by `reach` at most in each column; gap: the most that they differ. The first `banded` columns
    are cut into bands as wide as the reach: a row meets the rows of its own band and of the two beside it, so none is missed."""
    band = lambda c: F.floor(F.col(c) / reach)
    a, b = (df.dropna(subset=columns).select(F.col(key).alias(side), *[F.col(c).cast("double").alias(f"{side}_{c}") for c in columns]) for df, side in ((left, "a"), (right, "b")))
    keys = [f"__k{k}" for k in range(banded)]
    for k, c in zip(keys, columns, strict=False):
        a = a.withColumn(k, F.explode(F.sequence(band(f"a_{c}") - 1, band(f"a_{c}") + 1)))
        b = b.withColumn(k, band(f"b_{c}"))
    gaps = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return a.join(b, keys).withColumn("gap", gap).where(F.col("gap") <= reach).select("a", "b", "gap")
