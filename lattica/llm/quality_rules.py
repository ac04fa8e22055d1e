"""Quality rules: base limits, then robust multivariate outliers by minimum covariance determinant per language and source.

The vector of a text is made of ratios that are shrunk towards a usual value, so that short texts do not scatter more than long ones.
Per group, concentration steps run from two deterministic starts over all rows of the group (nothing is sampled):
each step sums counts, means and products by bins of the distance, takes the bins that hold the nearest `h_share` of the rows
(whole bins, so that the cut depends on no row order), and estimates again from those sums. The groups' estimates are looked up by
broadcast, by salted keys if they are too many, and rows are pre-aggregated per task, so a hot group costs no single task; a task then sees
at most BINS rows of sums per group and start. The start with the smaller determinant wins, one reweighting step follows, and where its
median exceeds that of a chi-square the distance is scaled down to it (never up: the floors below widen its unit already).

Defined cases: a null text is empty; an empty text has no words and fails the base rules; null languages and sources are values of
their own; a group of fewer than `min_rows` passing rows is pooled by language, then over all, and if even that is too small nothing
more is rejected; the covariance gets a floor per dimension, so ties and repeated rows cannot make it singular; repeated rows get the
same verdict; an empty table gives an empty result; other columns are only carried if asked for, those named like an added one as <name>_input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import fits, look_up, save, table, unclashed
from .statistics import COUNTS, with_statistics

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
H_SHARE, C_STEPS, MIN_ROWS = 0.75, 4, 60
#: Probability beyond the cut-off under normal data, and the factor on the squared distance for tails that are longer.
TAIL, SLACK = 1e-5, 1.5
SHRINK = 40.0
BINS_PER_E = 16  # bins of the squared distance for each factor of e
#: (name, floor of the standard deviation)
DIMENSIONS = [("word_length", 0.15), ("symbols", 0.03), ("upper", 0.03), ("marks", 0.05), ("dup_lines", 0.06), ("repeats", 0.05), ("line_words", 0.35), ("same", 0.05)]
P = len(DIMENSIONS)
TRI = [(i, j) for i in range(P) for j in range(i, P)]
X, MU, PREC = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)], [f"p{i}_{j}" for i, j in TRI]


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list:
    """Columns x0.. from the counts; the ratios are shrunk towards a usual value by SHRINK words' worth."""
    c = {name: F.col(name).cast("double") for name in ("n_words", "word_chars", "n_symbols", "n_upper", "n_lower", "n_exclaim", "n_pipes", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_words")}
    n = c["n_words"] + SHRINK
    letters = c["n_upper"] + c["n_lower"] + 5 * SHRINK
    values = [
        (c["word_chars"] + 5.5 * SHRINK) / n,
        F.sqrt(c["n_symbols"] / n),
        (c["n_upper"] + 0.15 * SHRINK) / letters,
        F.sqrt((c["n_exclaim"] + c["n_pipes"]) / n),
        c["n_dup_lines"] / (c["n_lines"] + 4),
        c["n_repeat_words"] / n,
        F.log((c["n_words"] + SHRINK) / (c["n_lines"] + SHRINK / 40)),
        c["n_same_words"] / n,
    ]
    return [v.alias(name) for v, name in zip(values, X, strict=True)]


def chi_square(p: int, share: float) -> float:
    """Quantile by Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * math.sqrt(2 / (9 * p))) ** 3


def grouped(stats: DataFrame, min_rows: int) -> DataFrame:
    """lang, source and the key of the group whose estimate serves them (null: none)."""
    n = stats.groupBy("lang", "source").agg(F.count_if(~base_failed()).alias("n"))
    small = F.when(F.col("n") < min_rows, F.col("n")).otherwise(0)
    n = n.withColumn("of_lang", F.sum(small).over(Window.partitionBy("lang")))
    pooled = (F.col("n") < min_rows) & (F.col("of_lang") < min_rows)
    n = n.withColumn("__pooled", pooled)
    # one row: what tasks have counted meets, not the groups
    n = n.crossJoin(n.agg(F.sum(F.when(F.col("__pooled"), F.col("n"))).alias("of_pooled"))).withColumn("of_all", F.when(F.col("__pooled"), F.col("of_pooled")))
    key = lambda *parts: F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return n.select(
        "lang", "source",
        F.when(F.col("n") >= min_rows, key("lang", "source")).when(F.col("of_lang") >= min_rows, key("lang")).when(F.col("of_all") >= min_rows, F.lit("all")).alias("key"),
    )


def _params(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    """Mean, upper triangle of the inverse (off the diagonal twice, as the sum over i <= j needs), log determinant."""
    cov = cov + np.diag([floor**2 for _, floor in DIMENSIONS])
    inverse = np.linalg.inv(cov)
    return [*mean, *(inverse[i, j] * (1 if i == j else 2) for i, j in TRI), float(np.linalg.slogdet(cov)[1])]


_PARAMS = ", ".join(f"{c} double" for c in [*MU, *PREC, "logdet"])


def _square(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, full = sums / n, np.zeros((P, P))
    for (i, j), v in zip(TRI, products, strict=True):
        full[i, j] = full[j, i] = v / n - mean[i] * mean[j]
    return mean, full


def distance():
    """Squared distance of x0.. to the estimate joined to the row."""
    return F.expr(DISTANCE)


DISTANCE = " + ".join(f"{c} * (x{i} - m{i}) * (x{j} - m{j})" for c, (i, j) in zip(PREC, TRI, strict=True))
_SUMS = ["count(*) as n", *(f"sum(x{i}) as s{i}" for i in range(P)), *(f"sum(x{i} * x{j}) as q{i}_{j}" for i, j in TRI)]


def _bin():
    return F.expr(f"cast(floor(ln(greatest({DISTANCE}, 1e-6)) * {BINS_PER_E}) as int)")


def _binned(rows: DataFrame, params: DataFrame, fit: bool) -> DataFrame:
    """Sums of all rows by group, start and bin of the squared distance. params: one row per group and start."""
    d = look_up(rows, params.drop("logdet"), ["key"], fit=fit).withColumn("bin", _bin())
    return d.groupBy("key", "start", "bin").agg(*map(F.expr, _SUMS))


def _step(rows: DataFrame, params: DataFrame, h_share: float, fit: bool, reweight: bool = False) -> DataFrame:
    def of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        upto = pdf["n"].cumsum().to_numpy()
        if reweight:
            median = math.exp((pdf["bin"].to_numpy()[np.searchsorted(upto, upto[-1] / 2)] + 0.5) / BINS_PER_E)
            most = math.log(chi_square(P, 0.975) * median / chi_square(P, 0.5)) * BINS_PER_E
            last = max(int((pdf["bin"].to_numpy() <= most).sum()), int(np.searchsorted(upto, math.ceil(h_share * upto[-1]))) + 1)
        else:
            last = int(np.searchsorted(upto, math.ceil(h_share * upto[-1]))) + 1
        sums = pdf.iloc[:last].drop(columns=["key", "start", "bin"]).sum().to_numpy(float)
        return pd.DataFrame([[*key, *_params(*_square(sums[0], sums[1 : P + 1], sums[P + 1 :]))]])

    return _binned(rows, params, fit).groupBy("key", "start").applyInPandas(of_group, f"key string, start int, {_PARAMS}")


def _starts(rows: DataFrame, fit: bool) -> DataFrame:
    """Medians with quartile ranges on the diagonal, and medians with the spatial-sign covariance at the same scale."""
    # rounded, so that exact percentiles keep a bounded number of distinct values
    grid = [F.expr(f"percentile(round(x{i}, 2), array(0.25, 0.5, 0.75)) as g{i}") for i in range(P)]
    centre, scale = [f"c{i}" for i in range(P)], [f"w{i}" for i in range(P)]
    marginal = rows.groupBy("key").agg(*grid).selectExpr("key", *(f"g{i}[1] as c{i}" for i in range(P)), *(f"greatest((g{i}[2] - g{i}[0]) / 1.349, {DIMENSIONS[i][1]}) as w{i}" for i in range(P)))
    units = look_up(rows, save(marginal, "centres"), ["key"], fit=fit).selectExpr("key", *centre, *scale, *(f"(x{i} - c{i}) / w{i} as u{i}" for i in range(P)))
    units = units.withColumn("norm", F.expr(" + ".join(f"u{i} * u{i}" for i in range(P)) + " + 1e-9"))
    signs = units.groupBy("key", *centre, *scale).agg(*[F.expr(f"avg(u{i} * u{j} / norm) as q{i}_{j}") for i, j in TRI])

    def of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        centre, scale = np.array([[row[f"c{i}"], row[f"w{i}"]] for i in range(P)], float).T
        sign = np.zeros((P, P))
        for i, j in TRI:
            sign[i, j] = sign[j, i] = row[f"q{i}_{j}"] * P
        return pd.DataFrame([[key[0], 0, *_params(centre, np.diag(scale**2))], [key[0], 1, *_params(centre, sign * np.outer(scale, scale))]])

    return signs.groupBy("key").applyInPandas(of_group, f"key string, start int, {_PARAMS}")


def estimates(rows: DataFrame, fit: bool, h_share: float = H_SHARE, c_steps: int = C_STEPS) -> DataFrame:
    """key, mean, inverse covariance, logdet and the factor that brings the median distance to a chi-square's. rows: key and x0..; fit: whether
    tables with two rows for each key can be broadcast."""
    params = save(_starts(rows, fit), "mcd")
    for _ in range(c_steps):
        params = save(_step(rows, params, h_share, fit), "mcd")
    best = params.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("logdet", "start"))).where("rank = 1").drop("rank")
    params = save(_step(rows, best, h_share, fit, reweight=True), "mcd")
    d = look_up(rows, params, ["key"], fit=fit).withColumn("bin", _bin()).groupBy("key", "bin").agg(F.count("*").alias("n"))
    upto = d.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy("key")))
    middle = upto.where(F.col("upto") * 2 >= F.col("all")).groupBy("key").agg(F.min("bin").alias("bin"))
    # the floors widen the distance's unit already, so the factor never narrows it
    return save(params.join(middle, "key").withColumn("factor", F.least(F.lit(1.0), chi_square(P, 0.5) / F.exp((F.col("bin") + 0.5) / BINS_PER_E))).drop("bin", "start"), "mcd")


def quality_rules(docs: DataFrame, keep: list[str] | None = None, h_share: float = H_SHARE, c_steps: int = C_STEPS, min_rows: int = MIN_ROWS, tail: float = TAIL, slack: float = SLACK) -> DataFrame:
    """Columns `keep` (doc_id if not given) and base counts, base_failed, distance2 (null: no estimate), kept. docs: text, lang, source and `keep`."""
    docs, keep = unclashed(docs, [*(keep or ["doc_id"]), "lang", "source"], [*COUNTS, *X, *MU, *PREC, "base_failed", "distance2", "kept", "key", "factor", "logdet"])
    stats = save(with_statistics(docs, keep), "statistics")
    keys = save(grouped(stats, min_rows), "groups")
    # with room for two rows of estimates for each language and source
    fit = fits(keys.withColumn("room", F.repeat(F.lit(" "), 2 * 16 * len([*MU, *PREC]))))
    rows = look_up(stats.where(~base_failed()).select("lang", "source", *vector()), keys, ["lang", "source"], fit=fit).where("key is not null").select("key", *X)
    rows = save(rows, "vectors")
    params = estimates(rows, fit, h_share, c_steps)
    out = stats.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), *vector())
    out = look_up(look_up(out, keys, ["lang", "source"], "left", fit), params.drop("logdet"), ["key"], "left", fit)
    out = out.withColumn("distance2", F.when(~F.col("base_failed"), distance() * F.col("factor")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= slack * chi_square(P, 1 - tail), F.lit(True))
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept")


QUERIES = {"op1_quality_rules": op1_quality_rules}
