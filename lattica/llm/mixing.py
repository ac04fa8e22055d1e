"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in tokens (words) and summed to cells of source, language and topic. The cells' weights are raked: in turn, each of the three
marginals is scaled to its target, for `rounds` rounds or until all are within `tolerance`. A document's weight is its tokens times its cell's
factor; a warning tells if they are not by then. The sample's expected size is `share` of all tokens, however skewed the table is: cells' expected tokens start as c * n * factor,
at most n, with the c that gives that size. What cells with probability 1 leave short is raked again over the others. A value that has
fewer tokens than its target asks for is taken whole, and the other values of its marginal share the rest by their targets. A last c brings
the sum back to the size. A document's probability is its cell's expected tokens over n; it is sampled if a hash of its id and text falls below
that. `reached` lists targets and the shares that the sample is expected to have. Up to SMALL_CELLS cells are planned as arrays in one task, more
by the same steps as Spark jobs.
Targets are shares of tokens; where none are given, a marginal is tempered: shares to the power `temper`, made to add up to 1.

The topic is learnt from the words of all documents (`topics`), or a column expression of the caller's (`topic_of`). One such comes with the
module, `topic`: the text's form by plain rules, tabular, legal, contact, long, medium or short.

Defined cases: a null text is empty and has no tokens, so weight 0 of its own, and the probability of its cell; null sources and languages are
values of their own; a cell without tokens keeps factor 1 and has probability `share`; cells of target 0 have probability 0, and where
the others hold less than `share`, they are taken whole; targets for values that do not occur are left out and the others scaled up;
repeated rows get the same decision; an empty table gives an empty result; other columns are only carried if asked for, those with the name of an
added one as <name>_input.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import topics
from ._shared import cut, look_up, save, small_batches, table, unclashed

ROUNDS, TOLERANCE, TEMPER, SHARE = 120, 1e-6, 0.7, 0.5
MARGINALS = ["source", "lang", "topic"]
#: Rounds between two looks at the gap, which make up one Spark job, and the number of cells up to which one task holds all.
ROUNDS_A_JOB, SMALL_CELLS = 6, 100_000


def tokens(text):
    return F.when(F.trim(text) == "", 0).otherwise(F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))).cast("long")


def topic(text):
    size = F.coalesce(F.length(text), F.lit(0))
    return (
        F.when(F.contains(text, F.lit(" | ")), "tabular").when(F.contains(text, F.lit("License")) | F.contains(text, F.lit("license")), "legal")
        .when(F.contains(text, F.lit("@")) | text.rlike(r"\+[0-9]"), "contact").when(size >= 4000, "long").when(size >= 800, "medium").otherwise("short")
    )


def targets(cells: DataFrame, marginal: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """value of the marginal, target share; the shares of what occurs add up to 1."""
    sums = cells.groupBy(marginal).agg(F.sum("n").alias("n"))
    if given:
        named = cells.sparkSession.createDataFrame(list(given.items()), "value string, share double")
        sums = sums.join(named, sums[marginal].eqNullSafe(named["value"])).select(marginal, "share")
    else:
        sums = sums.where("n > 0").select(marginal, F.pow("n", F.lit(temper)).alias("share"))
    whole = sums.agg(F.sum("share")).first()[0] or 1.0
    return sums.select(marginal, (F.col("share") / whole).alias(f"{marginal}_target"))


def _end(apart: float, tolerance: float, rounds: int) -> None:
    if apart > tolerance:
        warnings.warn(f"raking is {apart:.3g} away from its targets after {rounds} rounds", stacklevel=3)


def raked(cells: DataFrame, given: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """source, lang, topic, n, factor and the targets. cells: source, lang, topic and n, their tokens."""
    for m in MARGINALS:
        goal = targets(cells, m, (given or {}).get(m), temper).withColumnRenamed(m, "__value")
        cells = cells.join(goal, cells[m].eqNullSafe(goal["__value"]), "left").drop("__value").withColumn(f"{m}_target", F.coalesce(f"{m}_target", F.lit(0.0)))
    cells = save(cells, "cells")
    count, total = cells.agg(F.count("*"), F.sum("n")).first()
    cells = cells.withColumn("w", F.try_divide(F.col("n").cast("double"), F.lit(total)))
    if count <= SMALL_CELLS:
        cells = cells.coalesce(1)  # the windows below then need no shuffle
    apart = 0.0
    for done in range(0, rounds, ROUNDS_A_JOB):
        for m in MARGINALS * min(ROUNDS_A_JOB, rounds - done):
            now = F.sum("w").over(Window.partitionBy(m))
            cells = cells.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"{m}_target") / now).otherwise(0.0))
        cells = cut(cells)
        apart = 0.0
        for m in MARGINALS:
            gap = cells.groupBy(m, f"{m}_target").agg(F.sum("w").alias("w")).agg(F.max(F.abs(F.col("w") - F.col(f"{m}_target")))).first()[0]
            apart = max(apart, gap or 0.0)
        if apart <= tolerance:
            break
    _end(apart, tolerance, rounds)
    return cells.select(*MARGINALS, "n", F.when(F.col("n") > 0, F.col("w") * F.lit(total) / F.col("n")).otherwise(1.0).alias("factor"), *[f"{m}_target" for m in MARGINALS])


def scale(parts: DataFrame, most: str, size: str, total: float) -> float:
    """The c with sum(min(most, c * size)) = total, by Newton's method from below; where total is more than can be had, a c that takes all."""
    c, full = 0.0, -1
    while True:
        taken = F.col(size) * c >= F.col(most)
        n, sure, free = parts.agg(F.count_if(taken), F.sum(F.when(taken, F.col(most))), F.sum(F.when(~taken, F.col(size)))).first()
        if n <= full or not free:
            return c
        c, full = (total - (sure or 0)) / free, n


def calibrated(cells: DataFrame, share: float = SHARE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells, which are those of raked(), with probability: the sum of n * probability is `share` of the sum of n."""
    cells = save(cells.withColumn("w", F.when(F.col("n") > 0, F.col("n") * F.col("factor")).otherwise(0.0)), "raked")
    count, total, able = cells.agg(F.count("*"), F.sum("n"), F.sum(F.when(F.col("w") > 0, F.col("n")))).first()
    if not able:
        return cells.drop("w").withColumn("probability", F.when(F.col("n") > 0, 0.0).otherwise(share))
    size = min(share * total, float(able))
    start = scale(cells, "n", "w", size)
    if count <= SMALL_CELLS:
        cells = cells.coalesce(1)
    for m in MARGINALS:
        even = scale(cells.groupBy(m, f"{m}_target").agg(F.sum("n").alias("n")), "n", f"{m}_target", size)
        cells = cells.withColumn(f"{m}_size", F.least(F.sum("n").over(Window.partitionBy(m)), even * F.col(f"{m}_target")))
    cells = cut(cells.withColumn("w", F.least("n", start * F.col("w"))))
    apart = 0.0
    for done in range(0, rounds, ROUNDS_A_JOB):
        for m in MARGINALS * min(ROUNDS_A_JOB, rounds - done):
            now = F.sum("w").over(Window.partitionBy(m))
            full = F.sum(F.when(F.col("w") >= F.col("n"), F.col("n")).otherwise(0)).over(Window.partitionBy(m))
            goal = F.col(f"{m}_size")
            # what is short is made up by cells that are not full yet
            step = F.when((goal > now) & (now > full), (goal - full) / (now - full)).when((goal < now), goal / now).otherwise(1.0)
            cells = cells.withColumn("w", F.least("n", F.col("w") * step))
        cells = cut(cells)
        apart = 0.0
        for m in MARGINALS:
            gap = cells.groupBy(m, f"{m}_size").agg(F.sum("w").alias("w")).agg(F.max(F.abs(F.col("w") - F.col(f"{m}_size")))).first()[0]
            apart = max(apart, gap / size)
        if apart <= tolerance:
            break
    _end(apart, tolerance, rounds)
    last = scale(cells, "n", "w", size)
    return cells.withColumn("probability", F.when(F.col("n") > 0, F.least(F.lit(1.0), last * F.col("w") / F.col("n"))).otherwise(share)).drop("w", *[f"{m}_size" for m in MARGINALS])


def _arrays(cells: pd.DataFrame, given: dict[str, dict[str, float]] | None, temper: float, share: float, rounds: int, tolerance: float) -> pd.DataFrame:
    """What raked() and calibrated() add, for all cells at once, and how far the worse of the two is from its targets."""
    n, apart = cells["n"].to_numpy(float), 0.0
    codes = [pd.factorize(cells[m], use_na_sentinel=False)[0] for m in MARGINALS]
    goals = []
    for m, code in zip(MARGINALS, codes, strict=True):
        if given and given.get(m):
            share_of = cells[m].map(lambda v, m=m: given[m].get(None if pd.isna(v) else v, 0.0)).to_numpy(float)
            whole = np.zeros(code.max(initial=-1) + 1)
            whole[code] = share_of
        else:
            sums = np.bincount(code, n)
            whole = np.where(sums > 0, sums**temper, 0.0)
        goals.append((whole / (whole.sum() or 1.0))[code])

    def sweep(w: np.ndarray, aims: list[np.ndarray], full: bool, unit: float) -> tuple[np.ndarray, float]:
        gap = 0.0
        for done in range(rounds):
            for code, aim in zip(codes, aims, strict=True):
                now = np.bincount(code, w)[code]
                if full:
                    sure = np.bincount(code, np.where(w >= n, n, 0.0))[code]
                    step = np.ones(len(w))
                    more, less = (aim > now) & (now > sure), aim < now
                    step[more], step[less] = ((aim - sure)[more] / (now - sure)[more]), (aim[less] / now[less])
                    w = np.minimum(n, w * step)
                else:
                    w = np.divide(w * aim, now, out=np.zeros(len(w)), where=now > 0)
            if (done + 1) % ROUNDS_A_JOB == 0 or done + 1 == rounds:
                gap = max(np.abs(np.bincount(code, w)[code] - aim).max(initial=0.0) for code, aim in zip(codes, aims, strict=True)) / unit
                if gap <= tolerance:
                    break
        return w, gap

    def scale_of(most: np.ndarray, size: np.ndarray, total: float) -> float:
        c, full = 0.0, -1
        while True:
            taken = size * c >= most
            free = size[~taken].sum()
            if taken.sum() <= full or not free:
                return c
            c, full = (total - most[taken].sum()) / free, taken.sum()

    total = n.sum()
    w, apart = sweep(n / (total or 1.0), goals, False, 1.0)
    factor = np.divide(w * total, n, out=np.ones(len(n)), where=n > 0)
    w = np.where(n > 0, n * factor, 0.0)
    probability = np.where(n > 0, 0.0, share)
    if n[w > 0].sum():
        size = min(share * total, n[w > 0].sum())
        w, aims = np.minimum(n, scale_of(n, w, size) * w), []
        for code, goal in zip(codes, goals, strict=True):
            sums, aim = np.bincount(code, n), np.zeros(code.max() + 1)
            aim[code] = goal
            aims.append(np.minimum(sums, scale_of(sums, aim, size) * aim)[code])
        w, gap = sweep(w, aims, True, size)
        apart = max(apart, gap)
        probability = np.where(n > 0, np.minimum(1.0, np.divide(scale_of(n, w, size) * w, n, out=np.zeros(len(n)), where=n > 0)), share)
    return cells.assign(factor=factor, **{f"{m}_target": g for m, g in zip(MARGINALS, goals, strict=True)}, probability=probability, apart=apart)


def planned(cells: DataFrame, given: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, share: float = SHARE, rounds: int = ROUNDS, tolerance: float = TOLERANCE, small: int = SMALL_CELLS) -> DataFrame:
    """cells (source, lang, topic, n) with factor, targets and probability."""
    if cells.count() > small:
        return calibrated(raked(cells, given, temper, rounds, tolerance), share, rounds, tolerance)
    schema = ", ".join(["source string, lang string, topic string, n long, factor double", *(f"{m}_target double" for m in MARGINALS), "probability double, apart double"])
    out = cells.select(*[F.col(m).cast("string") for m in MARGINALS], F.col("n").cast("long")).groupBy().applyInPandas(lambda pdf: _arrays(pdf, given, temper, share, rounds, tolerance), schema)
    out = save(out, "planned")
    _end(out.agg(F.max("apart")).first()[0] or 0.0, tolerance, rounds)
    return out.drop("apart")


def reached(cells: DataFrame) -> DataFrame:
    """marginal, value, target, share: of each value, the target and its share of the sample's expected tokens. cells: those of calibrated()."""
    sums = [cells.groupBy(F.lit(m).alias("marginal"), F.col(m).alias("value"), F.col(f"{m}_target").alias("target")).agg(F.sum(F.col("n") * F.col("probability")).alias("part")) for m in MARGINALS]
    total = cells.agg(F.sum(F.col("n") * F.col("probability")).alias("whole"))
    return sums[0].unionByName(sums[1]).unionByName(sums[2]).crossJoin(F.broadcast(total)).select("marginal", "value", "target", F.try_divide("part", "whole").alias("share"))


def mixed(docs: DataFrame, keep: list[str] | None = None, given: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, share: float = SHARE, seed: int = 0, topic_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Columns `keep` (doc_id if not given) and topic, tokens, weight, probability, sampled. docs: doc_id, text, source, lang and `keep`.
    topic_of: a topic from the text; where none is given, topics are learnt."""
    docs, keep = unclashed(small_batches(docs), keep or ["doc_id"], ["topic", "tokens", "weight", "probability", "sampled", "factor"])
    draw = F.pmod(F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]), F.lit(1 << 53)) / float(1 << 53)
    rows = docs.select(*[docs[c] for c in keep], docs["source"].alias("__source"), docs["lang"].alias("__lang"), (topic_of or topics.sketch)(docs["text"]).alias("topic"), tokens(docs["text"]).alias("tokens"), draw.alias("__draw"))
    rows = save(rows, "counted")
    if topic_of is None:
        rows = rows.withColumn("topic", topics.fitted(rows.select(F.col("topic").alias("sketch"))).of(F.col("topic")))
    cells = save(rows.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), "topic").agg(F.sum("tokens").alias("n")), "cells")
    factors = planned(cells, given, temper, share)
    factors = save(factors.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), "topic", "factor", "probability"), "factors")
    joined = look_up(rows, factors, ["__source", "__lang", "topic"])
    return joined.select(*keep, "topic", "tokens", (F.col("tokens") * F.col("factor")).alias("weight"), "probability", (F.col("__draw") < F.col("probability")).alias("sampled"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 9).alias("probability"), "sampled")


QUERIES = {"op6_mixing": op6_mixing}
