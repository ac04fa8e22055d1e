"""Profiles, rollups, ranks and runs.

Defined cases, unless stated: nulls in a grouping column are a group of their own; an empty table gives no groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, filled, distinct, least, greatest; the last two by the column's own order, as strings. Each column is read by itself and counted by
    value, which tasks do before the shuffle. No rows: counts of 0."""

    def of(c: str) -> DataFrame:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        total = lambda n: F.coalesce(F.sum(n), F.lit(0))
        return values.agg(total("n").alias("rows"), total(F.when(F.col("v").isNotNull(), F.col("n"))).alias("filled"), F.count("v").alias("distinct"), F.min("v").cast("string").alias("least"), F.max("v").cast("string").alias("greatest")).select(F.lit(c).alias("column"), "*")

    out = of(columns[0])
    for c in columns[1:]:
        out = out.unionByName(of(c))
    return out


def value_sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n least distinct non-blank values, as text."""
    return df.select(F.trim(F.col(column).cast("string")).alias("value")).where("value != ''").distinct().orderBy("value").limit(n)


def runs(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Gaps and islands: each run of equal values with its length and ends."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    at = order[0]
    return df.withColumn("__run", changed).withColumn("__run", F.sum("__run").over(w)).groupBy(*partition, "__run", value).agg(F.count("*").alias("length"), F.min(at).alias("first"), F.max(at).alias("last")).drop("__run")


def ranked(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """All rows with their place in their group, from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group; Spark keeps k per task before the shuffle."""
    return ranked(df, group, order).where(F.col("rank") <= k)


def pivot_counts(df: DataFrame, group: list[str], by: str, values: list[str], total: str | None = None) -> DataFrame:
    """group and how many rows have each of the values; total: the name of a column with the number of all rows."""
    return df.groupBy(*group).agg(*[F.count_if(F.col(by) == v).alias(v) for v in values], *([F.count("*").alias(total)] if total else []))


def clean_counts(df: DataFrame, group: list[str], by: str, values: list[str], bad: list[str]) -> DataFrame:
    """As pivot_counts(), with clean: whether a group has none of the bad values."""
    return df.groupBy(*group).agg(*[F.count_if(F.col(by) == v).alias(v) for v in values], (F.count_if(F.col(by).isin(bad)) == 0).alias("clean"))


def child_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """key and how many rows of each child table (name: table and its column) refer to a parent, 0 where none do: what a deletion would take with it. A
    child's rows are counted in each task before they meet. Parents count once; null keys have no children."""
    out = parents.select(key).distinct()
    for name, (df, column) in children.items():
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"__{key}")).agg(F.count("*").alias(name))
        out = out.join(counts, F.col(key) == F.col(f"__{key}"), "left").drop(f"__{key}").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def distinct_list(df: DataFrame, group: list[str], column: str, separator: str = ", ") -> DataFrame:
    """group and the distinct non-null values in their order, joined; empty where there are none. The distinct values of a group must fit in a row."""
    return df.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), separator).alias(column))


def ordered_list(df: DataFrame, group: list[str], order: str, column: str) -> DataFrame:
    """group and its distinct non-null values as an array, by first occurrence in an order; empty where there are none."""
    first = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.min(order).alias("__at"))
    groups = df.select(*group).distinct()
    listed = first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", column))), lambda x: x[column]).alias(column))
    names = {c: f"__{c}" for c in group}
    equal = F.lit(True)
    for c in group:
        equal &= F.col(c).eqNullSafe(F.col(names[c]))
    kind = df.schema[column].dataType.simpleString()
    return groups.join(listed.withColumnsRenamed(names), equal, "left").select(*group, F.coalesce(column, F.array().cast(f"array<{kind}>")).alias(column))


def collapsed(df: DataFrame, keys: list[str], order: str, listed: str, number: str, separator: str = ",") -> DataFrame:
    """keys and, of each group: place (its least value of `order`), the distinct values of `listed` by first occurrence, joined, and `number`: the
    one value if all are equal, else the sum, as whole numbers; null if a value is none."""
    whole = F.col(number).try_cast("long")
    groups = df.groupBy(*keys).agg(F.min(order).alias("place"), F.when(F.min(number).eqNullSafe(F.max(number)), F.min(whole)).when(F.count(whole) == F.count("*"), F.sum(whole)).alias(number))
    lists = ordered_list(df, keys, order, listed).withColumn(listed, F.array_join(listed, separator)).withColumnsRenamed({c: f"__{c}" for c in keys})
    equal = F.lit(True)
    for c in keys:
        equal &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return groups.join(lists, equal).select(*keys, "place", listed, number)


def flag_counts(df: DataFrame, flags: str, most: int, sample: str) -> DataFrame:
    """flag, n, samples of an array column: how many rows have a flag, and the `most` least values of `sample` among them. Spark keeps `most`
    rows of a flag in each task before the shuffle."""
    each = df.select(F.explode(F.array_distinct(flags)).alias("flag"), F.col(sample).alias("sample"))
    counts = each.groupBy("flag").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("flag").orderBy("sample"))
    some = each.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("flag").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    return counts.withColumnRenamed("flag", "__flag").join(some, F.col("flag").eqNullSafe(F.col("__flag"))).select("flag", "n", "samples")


def progress(df: DataFrame, group: list[str], status: str, done: str, running: str) -> DataFrame:
    """group, total, done, running, open (neither) and complete: whether all are done."""
    n = lambda v: F.count_if(F.col(status) == v)
    return df.groupBy(*group).agg(F.count("*").alias("total"), n(done).alias("done"), n(running).alias("running"), (F.count("*") - n(done) - n(running)).alias("open"), (F.count("*") == n(done)).alias("complete"))


def grid_clusters(points: DataFrame, size: float, least: int) -> DataFrame:
    """x, y (means) and n of the points (x, y) that round to the same multiple of size, halves up, where there are `least` of them."""
    cell = lambda c: F.floor(F.col(c) / size + 0.5)
    return points.where("x is not null and y is not null").groupBy(cell("x").alias("cx"), cell("y").alias("cy")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).where(F.col("n") >= least).select("x", "y", "n")


def bounds(boxes: DataFrame, group: list[str]) -> DataFrame:
    """group and the least box that holds all its boxes; null coordinates count for nothing."""
    return boxes.groupBy(*group).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def word_score(df: DataFrame, words: list[str], weights: dict[str, float], key: str, k: int) -> DataFrame:
    """key, score of the k best rows: for each array column its weight times how many of the words it holds; rows without any are left out, ties
    go to the smaller key."""
    asked = F.array(*map(F.lit, sorted(set(words)))).cast("array<string>")
    score = F.lit(0.0)
    for c, weight in weights.items():
        score += F.coalesce(F.size(F.array_intersect(F.col(c), asked)), F.lit(0)) * F.lit(float(weight))
    return df.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def similar_vectors(df: DataFrame, vector: list[float], key: str, column: str, content: Column, k: int) -> DataFrame:
    """key, similarity of the k vectors that are nearest by cosine, of rows with equal content the best alone; ties go to the smaller key. Vectors
    that are null, of another length, with nulls or of length 0 take no part."""
    asked = F.array(*[F.lit(float(x)) for x in vector])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    own = F.col(column)
    rows = df.where(F.size(own) == len(vector)).select(key, content.alias("__content"), F.try_divide(dot(own, asked), F.sqrt(dot(own, own)) * F.sqrt(dot(asked, asked))).alias("similarity")).where("similarity is not null and not isnan(similarity)")
    # the best row of each content: an aggregate, so equal contents meet after each task has kept one
    best = rows.groupBy("__content").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col(key))).alias("b"))
    return best.select(F.col(f"b.{key}").alias(key), (-F.col("b.s")).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
