"""Quality classifier: random Fourier features of document statistics, ridge regression from partition-summed normal equations, isotonic calibration.

Every labelled training row counts; tasks sum Z'Z and Z'y, Spark adds the sums row by row, and the driver solves one system of
`features` + 1 unknowns. Calibration pools adjacent violators over at most CAL_BINS bins of the raw score, from training rows that the
ridge did not see. Standardised inputs are clipped at six deviations, so that a text far from all others gets the score of the edge that it lies
beyond. Language, source, labels and ids are no inputs.

Defined cases: a null or empty text has statistics of zeros and gets a score like any other; null labels count as none; repeated label
rows count each; a null doc_id stands for the empty text in the split; with no training labels the score is 0.5, with one class only it
is that class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import save, table
from .statistics import COUNTS, with_statistics

FEATURES, GAMMA, RIDGE, SEED = 256, 0.2, 1e-3, 7
CAL_BINS, THRESHOLD = 2000, 0.3
MOST_TASKS = 1024  # that sum products; each leaves a row for each feature


def bucket(column):
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def inputs(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios and logarithms of the counts, a row for each text."""
    c = {k: np.asarray(v, float) for k, v in c.items()}
    n, lines, letters, chars = c["n_words"] + 1, c["n_lines"] + 1, c["n_upper"] + c["n_lower"] + 1, c["word_chars"] + 1
    columns = [np.log(n), np.log(chars / n), np.sqrt(c["n_symbols"] / n), np.log((c["n_words"] + 1) / lines), c["n_dup_lines"] / lines, c["n_repeat_words"] / n, c["n_distinct"] / n, c["n_upper"] / letters, np.sqrt(c["n_digits"] / chars), np.sqrt(c["n_punct"] / chars), np.sqrt(c["n_exclaim"] / n), np.sqrt(c["n_pipes"] / n), np.sqrt(c["n_long_words"] / n)]
    return np.stack(columns, 1)


class Fourier:
    """cos(xW + b) approximates a Gaussian kernel of the standardised inputs."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.normal(0, gamma, (len(mean), features)), rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(z), 1))], 1)


def _counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the inputs over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = inputs(_counts(batch))
                k = np.arange(x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), float(len(x)))), pa.array(x.sum(0)), pa.array((x * x).sum(0))], names=["k", "n", "s", "q"])

    got = rows.mapInArrow(run, "k long, n double, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").toPandas()
    if not len(got):
        return np.zeros(0), np.zeros(0)
    mean = (got["s"] / got["n"]).to_numpy()
    return mean, np.sqrt(np.maximum((got["q"] / got["n"]).to_numpy() - mean**2, 1e-4))


def _solve(rows: DataFrame, fourier: Fourier, ridge: float) -> np.ndarray:
    """Ridge weights: each task sums its rows' products, a row for each feature; Spark adds them."""
    d = len(fourier.b) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((d, d + 2)), False
        for batch in batches:
            z, y = fourier(inputs(_counts(batch))), batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            total += np.concatenate([z.T @ z, (z.T @ y)[:, None], np.full((d, 1), float(len(y)))], 1)
            any_row |= bool(len(y))
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([r.tobytes() for r in total], pa.binary())], names=["k", "sums"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "sums": [np.sum([np.frombuffer(x) for x in pdf["sums"]], 0).tobytes()]})

    # labelled statistics are some hundred bytes a row: a bounded number of tasks leaves fewer sums to add
    got = rows.coalesce(MOST_TASKS).mapInArrow(products, "k long, sums binary").groupBy("k").applyInPandas(add, "k long, sums binary").toPandas().sort_values("k")
    total = np.stack([np.frombuffer(x) for x in got["sums"]])
    n = total[0, -1]
    return np.linalg.solve(total[:, :d] / n + ridge * np.eye(d), total[:, d] / n)


def isotonic(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of the values: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for w, v in zip(weights, values, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks])


def _scored(rows: DataFrame, fourier: Fourier, beta: np.ndarray, keep: list[str], knots: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = fourier(inputs(_counts(batch))) @ beta if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.interp(raw, *knots) if knots else raw)], names=[*keep, "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted. docs: doc_id, text; labels: doc_id, quality."""
    stats = save(with_statistics(docs, ["doc_id"]), "statistics")
    given = labels.select(labels["doc_id"].alias("__id"), labels["quality"].cast("double").alias("quality")).where("quality is not null and __id is not null")
    train = save(stats.join(given, stats["doc_id"] == F.col("__id")).where(bucket(F.col("doc_id")) % 5 != 0).select(*COUNTS, "quality", ((bucket(F.col("doc_id")) / 5).cast("long") % 4 == 0).alias("calibrates")), "train")
    fit, cal = train.where("not calibrates"), train.where("calibrates")
    mean, scale = _moments(fit)
    if not len(mean):
        fit = cal = train
        mean, scale = _moments(train)
    out = stats.withColumn("held_out", bucket(F.col("doc_id")) % 5 == 0)
    if len(mean):
        fourier = Fourier(mean, scale, features, gamma, seed)
        beta = _solve(fit, fourier, ridge)
        raw = _scored(cal, fourier, beta, ["quality"], None)
        at = F.floor(F.least(F.greatest(F.col("score"), F.lit(-0.5)), F.lit(1.4999)) * (CAL_BINS / 2)).cast("int")
        bins = raw.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("quality").alias("y")).orderBy("bin").toPandas()
        knots = ((bins["bin"].to_numpy() + 0.5) * (2 / CAL_BINS), np.clip(isotonic(bins["n"].to_numpy(float), bins["y"].to_numpy()), 0, 1)) if len(bins) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        # steps of equal fit keep their order: a thousandth of the raw score is mixed in
        knots = (np.concatenate([[-1.0], knots[0], [2.0]]), np.concatenate([[knots[1][0]], knots[1], [knots[1][-1]]]))
        knots = (knots[0], 0.999 * knots[1] + 0.001 * np.clip((knots[0] + 1) / 3, 0, 1))
        out = _scored(out, fourier, beta, ["doc_id", "held_out"], knots)
    else:
        out = out.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
