"""Joins on text keys with measured match rates, and diffs by key.

Defined cases, unless stated: a blank or null key matches nothing; repeated rows match each; an empty side matches nothing; columns of the
two sides that share a name are both returned, as Spark's join does. Names that begin with two underscores are taken."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import normalised, trimmed, word_set
from lattica.sources.shared import look_up, save

#: Rows of a word in one task.
SPLIT = 100_000
#: Pairs that a task takes in order.
ONE_TASK = 100_000
KEYS = {"exact": trimmed, "normalised": normalised}


def key_join(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column, kind: str = "exact", how: str = "left") -> DataFrame:
    """Rows of left with their matches by key."""
    key = KEYS[kind]
    return left.withColumn("__k", F.nullif(key(left_on), F.lit(""))).join(right.withColumn("__r", key(right_on)), F.col("__k") == F.col("__r"), how).drop("__k", "__r")


def token_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """left_id, right_id of rows that share a word (right_id gets _right behind it if the names are equal): an equi-join of words instead of a
    comparison of all sets. how: inner, or left, which adds a row with a null right_id for each id of left without a match."""
    name = f"{right_id}_right" if right_id == left_id else right_id
    a = left.select(left_id, F.explode(word_set(F.col(left_on))).alias("__w"))
    b = right.select(F.col(right_id).alias(name), F.explode(word_set(F.col(right_on))).alias("__w"))
    # a word that very many rows of left have is dealt to several tasks, and right's rows of it to each of those
    hot = save(a.groupBy("__w").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("__parts")).where("__parts > 1"), "hot-words")
    parts = F.coalesce("__parts", F.lit(1))
    a = look_up(a, hot, ["__w"], "left").withColumn("__part", F.pmod(F.xxhash64(left_id), parts).cast("int")).drop("__parts")
    b = look_up(b, hot, ["__w"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    pairs = a.join(b, ["__w", "__part"]).select(left_id, name).distinct()
    if how == "inner":
        return pairs
    rest = left.select(F.col(left_id).alias("__id")).distinct().join(pairs.select(left_id), F.col("__id").eqNullSafe(F.col(left_id)), "left_anti")
    return pairs.unionByName(rest.select(F.col("__id").alias(left_id), F.lit(None).cast(right.schema[right_id].dataType).alias(name)))


def match_survey(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column, kind: str = "exact") -> DataFrame:
    """One row: how many distinct non-blank values of left there are (den), and how many right has as well (num)."""
    key = KEYS[kind]
    a = left.select(trimmed(left_on).alias("v")).where("v != ''").distinct().select("v", F.nullif(key(F.col("v")), F.lit("")).alias("k"))
    b = right.select(key(right_on).alias("k")).distinct().withColumn("found", F.lit(1))
    return a.join(b, "k", "left").agg(F.count("found").alias("num"), F.count("*").alias("den"))


def survey(left: DataFrame, right: DataFrame, left_on: str, right_on: str, kind: str = "exact") -> DataFrame:
    """One row: surveyed, unbacked, num, den. As match_survey() where both tables have their column; else surveyed is false, unbacked tells which side has
    not (left, right or both) and the numbers are null, since nothing was counted. Words are compared by kind `words`."""
    lacks = [side for side, df, c in (("left", left, left_on), ("right", right, right_on)) if c not in df.columns]
    if lacks:
        row = "false as surveyed", f"'{'both' if len(lacks) == 2 else lacks[0]}' as unbacked", "cast(null as bigint) as num", "cast(null as bigint) as den"
        return left.sparkSession.range(1).selectExpr(*row)
    counted = token_survey(left, right, F.col(left_on), F.col(right_on)) if kind == "words" else match_survey(left, right, F.col(left_on), F.col(right_on), kind)
    return counted.select(F.lit(True).alias("surveyed"), F.lit(None).cast("string").alias("unbacked"), "num", "den")


def token_survey(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column) -> DataFrame:
    """As match_survey(), where a value matches if right has one of its words."""
    values = left.select(trimmed(left_on).alias("v")).where("v != ''").distinct()
    pool = right.select(F.explode(word_set(right_on)).alias("w")).distinct()
    found = values.select("v", F.explode(word_set(F.col("v"))).alias("w")).join(pool, "w", "left_semi").select("v").distinct()
    return values.join(found.withColumn("found", F.lit(1)), "v", "left").agg(F.count("found").alias("num"), F.count("*").alias("den"))


def with_flag(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """left and whether right has a row with the same columns `on`; no row is repeated. A null equals a null."""
    keys = right.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct().withColumn("__found", F.lit(True))
    equal = F.lit(True)
    for c in on:
        equal &= left[c].eqNullSafe(F.col(f"__{c}"))
    return left.join(keys, equal, "left").withColumn(name, F.col("__found").isNotNull()).drop("__found", *[f"__{c}" for c in on])


def prefix_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Pairs of rows where one text, in lower case, begins with the other, or equals it; blank texts match nothing. A text is looked for by the
    hash of its first 2**k characters, the most that it has; longer ones have a hash for each power of two, so a text has as many rows as its length has
    digits in base two. What shares a hash is then compared whole."""
    a, b = left.withColumn("__a", F.lower(trimmed(F.col(left_on)))), right.withColumn("__b", F.lower(trimmed(F.col(right_on))))
    most = lambda c: F.floor(F.log2(F.length(c))).cast("int")
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)
    head = lambda c, k: F.struct(k.alias("k"), F.xxhash64(F.substring(F.col(c), F.lit(1), power(k))).alias("h"))
    one_key = lambda df, c: df.where(F.length(c) > 0).withColumn("__h", head(c, most(c)))
    all_keys = lambda df, c: df.where(F.length(c) > 0).withColumn("__h", F.explode(F.transform(F.sequence(F.lit(0), most(c)), lambda k: head(c, k))))
    columns = [*left.columns, *right.columns]
    one = all_keys(a, "__a").withColumnRenamed("__h", "__g").join(one_key(b, "__b"), (F.col("__g") == F.col("__h")) & F.startswith("__a", "__b"))
    two = all_keys(b, "__b").withColumnRenamed("__h", "__g").join(one_key(a, "__a"), (F.col("__g") == F.col("__h")) & F.startswith("__b", "__a") & (F.col("__a") != F.col("__b")))
    return one.select(*columns).unionByName(two.select(*columns))


def first_match(left: DataFrame, right: DataFrame, left_id: str, keys: Column, right_key: str, order: list[str | Column]) -> DataFrame:
    """left_id and the columns of the first row of right, in an order, whose normalised key is among a row's keys (an array of texts), each key as
    normalised; nulls where there is none. Repeated ids of left count as one."""
    wanted = left.select(F.col(left_id).alias("__id"), F.explode(keys).alias("__key")).select("__id", F.nullif(normalised(F.col("__key")), F.lit("")).alias("__key")).distinct()
    # the first row of a key is all that can be first for any row that has it
    one = right.withColumn("__key", normalised(F.col(right_key))).withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).where("__n = 1").drop("__n")
    found = wanted.join(one, "__key").withColumn("__n", F.row_number().over(Window.partitionBy("__id").orderBy(*order))).where("__n = 1").drop("__n", "__key")
    return left.select(left_id).distinct().join(found, F.col(left_id).eqNullSafe(F.col("__id")), "left").drop("__id")


def reciprocal(rows: DataFrame, origin: str, target: str, by: list[str] | None = None) -> DataFrame:
    """by and pairs lo < hi of which each refers to the other, within equal values of `by`."""
    by = by or []
    pairs = rows.select(*by, F.least(origin, target).alias("lo"), F.greatest(origin, target).alias("hi"), (F.col(origin) < F.col(target)).alias("up")).where(f"{origin} != {target}")
    return pairs.groupBy(*by, "lo", "hi").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down")).where("up and down").select(*by, "lo", "hi")


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and status: matched, differing, missing (from new) or extra (in new). A key stands for its least row; further rows of a key are not
    compared (multiset_match counts them). A null key equals a null key."""
    one = lambda df, name: df.groupBy(*keys).agg(F.struct(F.min(F.struct(*columns)).alias("row")).alias(name))
    a, b = one(old, "__a"), one(new, "__b").withColumnsRenamed({c: f"__{c}" for c in keys})
    equal = F.lit(True)
    for c in keys:
        equal &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = a.join(b, equal, "full")
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a").eqNullSafe(F.col("__b")), "matched").otherwise("differing")
    return both.select(*[F.when(F.col("__a").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in keys], status.alias("status"))


def multiset_match(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matched: how many equal rows the two have, each used once. Counts meet, not rows."""
    one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return one(expected, "__a").join(one(found, "__b"), keys).select(*keys, F.least("__a", "__b").alias("matched"))


def row_match(expected: DataFrame, found: DataFrame, keys: list[str], expected_id: str, found_id: str) -> DataFrame:
    """expected_id, found_id: rows with equal keys, each used once, both sides in the order of their ids; found_id is null where none is left."""
    numbered = lambda df, i: df.select(*keys, i, F.row_number().over(Window.partitionBy(*keys).orderBy(i)).alias("__n"))
    return numbered(expected, expected_id).join(numbered(found, found_id), [*keys, "__n"], "left").select(expected_id, found_id)


def column_overlap(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """column, old, new, both: the distinct non-blank values of each, and how many are in both."""
    cells = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), trimmed(F.col(c)).alias("value")) for c in columns])).alias("c")).select("c.*").where("value != ''").distinct().withColumn(side, F.lit(1))
    both = cells(old, "__a").join(cells(new, "__b"), ["column", "value"], "full")
    return both.groupBy("column").agg(F.count("__a").alias("old"), F.count("__b").alias("new"), F.count(F.col("__a") + F.col("__b")).alias("both"))


def mutual_pairs(pairs: DataFrame, left: str, right: str, rounds: int = 2) -> DataFrame:
    """left, right, round: pairs of which each is the other's only candidate; those taken, the same again among what is left, and so on. Pairs with a null
    are left out, repeated ones count once. Candidates are counted before they meet, so an id with very many is a row."""
    open_ = save(pairs.select(left, right).dropna().distinct(), "open")
    taken = []
    for k in range(1, rounds + 1):
        alone = lambda own, other: open_.groupBy(own).agg(F.count("*").alias("__n"), F.min(other).alias(other)).where("__n = 1").select(left, right)  # noqa: B023, E731
        taken.append(save(alone(left, right).join(alone(right, left), [left, right]).withColumn("round", F.lit(k)), "taken"))
        if k < rounds:
            open_ = save(open_.join(taken[-1].select(left), left, "left_anti").join(taken[-1].select(right), right, "left_anti").select(left, right), "open")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def token_rows(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_on: str, right_on: str) -> DataFrame:
    """All rows of left with the rows of right that share a word with theirs, nulls where there are none; ids tell a side's rows apart, and the sides'
    columns that share a name are both returned. Whole rows meet after ids have, so words never carry them."""
    pairs = token_join(left.select(F.col(left_id).alias("__l"), F.col(left_on).alias("__lt")), right.select(F.col(right_id).alias("__r"), F.col(right_on).alias("__rt")), "__l", "__r", "__lt", "__rt")
    return left.join(pairs, left[left_id] == pairs["__l"], "left").join(right, pairs["__r"] == right[right_id], "left").drop("__l", "__r")


def greedy_pairs(pairs: DataFrame, left: str, right: str, distance: str, one_task: int = ONE_TASK) -> DataFrame:
    """The pairs that a greedy assignment takes, nearest first, each left and each right once, ties to the smaller left, then right. A pair that
    is the first of both its ends is taken in any case, so each round takes all of those at once; once no more than `one_task` pairs are left, one task
    takes them in order, so chains of pairs don't make rounds."""
    order = F.struct(distance, left, right)
    open_, taken = save(pairs.select(left, right, distance).dropna(), "open"), []
    while open_.limit(one_task + 1).count() > one_task:
        of_left = open_.groupBy(left).agg(F.min(order).alias("__l"))
        of_right = open_.groupBy(right).agg(F.min(order).alias("__r"))
        now = save(of_left.select(F.col(f"__l.{left}").alias(left), F.col(f"__l.{right}").alias(right), "__l").join(of_right, right).where(F.col("__l") == F.col("__r")).select(left, right, F.col(f"__l.{distance}").alias(distance)), "taken")
        taken.append(now)
        open_ = save(open_.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti").select(left, right, distance), "open")

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = (set(), set()), []
        pdf = pdf.sort_values([distance, left, right], kind="stable")
        for a, b in zip(pdf[left], pdf[right], strict=True):
            keep.append(a not in used[0] and b not in used[1])
            if keep[-1]:
                used[0].add(a)
                used[1].add(b)
        return pdf[np.array(keep, bool)]

    out = save(open_.groupBy().applyInPandas(in_order, open_.schema), "taken")
    for t in taken:
        out = out.unionByName(t)
    return out


def overlap_samples(old: DataFrame, new: DataFrame, columns: list[str], n: int) -> DataFrame:
    """column, only_old, only_new: the n least distinct non-blank values of each column that the other table's has not. Spark keeps n of a column in
    each task before the shuffle."""
    cells = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), trimmed(F.col(c)).alias("value")) for c in columns])).alias("c")).select("c.*").where("value != ''").distinct()
    a, b = save(cells(old), "cells"), save(cells(new), "cells")

    def least(df: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
        return df.withColumn("__n", rank).where(F.col("__n") <= n).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias(name))

    every = old.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    empty = F.array().cast("array<string>")
    out = every.join(least(a.join(b, ["column", "value"], "left_anti"), "only_old"), "column", "left").join(least(b.join(a, ["column", "value"], "left_anti"), "only_new"), "column", "left")
    return out.select("column", F.coalesce("only_old", empty).alias("only_old"), F.coalesce("only_new", empty).alias("only_new"))
