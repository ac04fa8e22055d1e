"""Rows in an order: filling, runs, islands, latest rows. Spark sorts each group in one task, spilling to disk; `by` must split the rows.

Defined cases, unless stated: nulls in `by` are a group of their own; order columns with ties are ordered by what else is given; an empty table
gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(by: list[str], order: list[str | Column], last: int = 0):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def forward_fill(df: DataFrame, by: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """Nulls take the last value before them in their group; those before the first value stay."""
    return df.withColumns({c: F.last(c, ignorenulls=True).over(_upto(by, order)) for c in columns})


def agreed_fill(df: DataFrame, by: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """Nulls take the value that their group has last before and first after them, if the two are equal; other nulls stay."""
    after = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    before = {c: F.last(c, ignorenulls=True).over(_upto(by, order)) for c in columns}
    return df.withColumns({c: F.coalesce(c, F.when(before[c] == F.first(c, ignorenulls=True).over(after), before[c])) for c in columns})


def numbered_on(df: DataFrame, by: list[str], order: list[str | Column], column: str, name: str) -> DataFrame:
    """df and `name`: the whole number of `column`, or where it is null, one more than the greatest that the group has before, filled ones included; null before
    the first number. Each filled number depends on those before it; since a null adds one to whatever is greatest, the greatest number less the
    nulls up to it, plus the nulls up to here, is the same in one pass. `order` must tell a group's rows apart."""
    upto, n = _upto(by, order), F.col(column).cast("long")
    counted = df.withColumn("__nulls", F.count_if(n.isNull()).over(upto))
    greatest = F.max(n - F.col("__nulls")).over(upto) + F.col("__nulls")
    return counted.withColumn(name, F.coalesce(n, greatest)).drop("__nulls")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order. Spark keeps one row of a group in each task before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rank = 1").drop("__rank")


def continued(df: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df and whether a row is not its group's first."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1)


def islands(df: DataFrame, by: list[str], start: str, end: str, gap: float = 0.0) -> DataFrame:
    """by, start, end, n of the islands that intervals form: an interval belongs to the last island if it begins at most `gap` behind the greatest
    end so far. Intervals with a null end, or inverted, are left out."""
    df = df.where(F.col(start) <= F.col(end))
    reach = F.max(end).over(_upto(by, [start, end], -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + F.lit(gap)), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(_upto(by, [start, end]))).groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def covered(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """by, covered, span: how long a group's intervals are together where each point counts once, and from the least start to the greatest end."""
    df = df.where(F.col(start) <= F.col(end))
    reach = F.coalesce(F.max(end).over(_upto(by, [start, end], -1)), F.col(start))
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), reach))
    return df.withColumn("__new", new).groupBy(*by).agg(F.sum("__new").alias("covered"), (F.max(end) - F.min(start)).alias("span"))


def remaining(df: DataFrame, other: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """by, start, end: what of df's intervals is left without those of `other`, as the fewest intervals, by a sweep over the points where any begins or ends.
    Points are counted before they are sorted, so intervals that repeat meet as one row. Intervals with a null end, of no length or inverted are left out."""

    def points(rows: DataFrame, ours: int) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col(start).alias("__at"), F.lit(1).alias("__d")), F.struct(F.col(end).alias("__at"), F.lit(-1).alias("__d")))).alias("p")
        return rows.where(F.col(start) < F.col(end)).select(*by, ends).select(*by, "p.__at", (F.col("p.__d") * ours).alias("__a"), (F.col("p.__d") * (1 - ours)).alias("__b"))

    marks = points(df, 1).unionByName(points(other, 0)).groupBy(*by, "__at").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    order = Window.partitionBy(*by).orderBy("__at")
    left = (F.sum("__a").over(_upto(by, ["__at"])) > 0) & (F.sum("__b").over(_upto(by, ["__at"])) == 0)
    swept = marks.select(*by, "__at", left.alias("__left"), F.lead("__at").over(order).alias("__to"))
    begins = F.when(F.col("__left") & ~F.coalesce(F.lag("__left").over(order), F.lit(False)), 1).otherwise(0)
    runs = swept.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(_upto(by, ["__at"]))).where("__left")
    return runs.groupBy(*by, "__run").agg(F.min("__at").alias(start), F.max("__to").alias(end)).drop("__run")


def chained(df: DataFrame, by: list[str], across: str, tolerance: float, start: str, end: str, gap: float = 0.0, anchored: bool = False) -> DataFrame:
    """by, line, lo, hi, start, end, n of the islands that pieces along lines form, on two levels. Pieces are of one line if their values of `across`, sorted, follow
    each other by `tolerance` at most (anchored: if they are up to that far behind the line's first value, and the next value begins another);
    along a line they are islands, as of islands(), with gaps up to `gap`. line: its least value; lo, hi: an island's own. The distinct values of `across` are sorted,
    not the rows. Pieces with a null in across or an end, or inverted, are left out; pieces of no length are dots."""
    df = df.where(F.col(across).isNotNull() & (F.col(start) <= F.col(end)))
    values = df.select(*by, F.col(across).alias("__v")).distinct()
    if anchored:
        lined = begun(values, by, "__v", tolerance, "line", inclusive=True)
    else:
        new = F.when(F.col("__v") - F.lag("__v").over(Window.partitionBy(*by).orderBy("__v")) <= tolerance, 0).otherwise(1)
        lined = values.withColumn("__new", new).withColumn("line", F.last(F.when(F.col("__new") == 1, F.col("__v")), ignorenulls=True).over(_upto(by, ["__v"]))).drop("__new")
    equal = F.col(across) == F.col("__v")
    for c in by:
        equal &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    df = df.select(*by, across, start, end).join(lined.withColumnsRenamed({c: f"__{c}" for c in by}), equal).select(*by, "line", across, start, end)
    inner = [*by, "line"]
    reach = F.max(end).over(_upto(inner, [start, end], -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + F.lit(gap)), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(_upto(inner, [start, end])))
    return marked.groupBy(*inner, "__island").agg(F.min(across).alias("lo"), F.max(across).alias("hi"), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def sliding(df: DataFrame, by: list[str], order: list[str | Column], column: str, n: int, name: str) -> DataFrame:
    """df's rows that n - 1 rows of their group follow, and the values of those n rows as an array (nulls are left out, as arrays are collected)."""
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, n - 1)
    return df.withColumn("__n", F.count(F.lit(1)).over(ahead)).withColumn(name, F.collect_list(column).over(ahead)).where(F.col("__n") == n).drop("__n")


def bands(df: DataFrame, by: list[str], value: str, width: float, name: str = "band", inclusive: bool = False) -> DataFrame:
    """df and the first value of each row's band: in the order of their values, rows belong to a band up to less than `width` behind its first one
    (inclusive: up to `width`), and the next row begins another. Each begin depends on the one before, so one pass goes over the distinct values as they come in sorted partitions; no
    group is held. A null value is in no band. Column names that begin with two underscores are taken."""
    keyed = df.withColumn("__v", F.col(value).cast("double"))
    points = keyed.select(*by, "__v").where("__v is not null").distinct()
    equal = F.col("__v") == F.col("__value")
    for c in by:
        equal &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    marked = begun(points, by, "__v", width, name, inclusive).withColumnsRenamed({"__v": "__value"} | {c: f"__{c}" for c in by})
    return keyed.join(marked, equal, "left").select(*df.columns, name)


def begun(points: DataFrame, by: list[str], value: str, width: float, name: str, inclusive: bool = False) -> DataFrame:
    """by, value and name, the first value of the band, as of bands(), of values that are not null and differ within a group."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(value)) == 1 if by else F.row_number().over(Window.orderBy(value)) == 1
    sorted_ = points.select(*by, value, F.col(value).cast("double").alias("__at")).withColumn("__first", first)
    width = float(width)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, end = 0.0, 0.0
        for batch in batches:
            begins = []
            for at, new in zip(batch.column("__at").to_pylist(), batch.column("__first").to_pylist(), strict=True):
                # NaN comes last and begins a band
                if new or not (at <= end if inclusive else at < end):
                    begin, end = at, at + width
                begins.append(begin)
            own = batch.select([*by, value])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(begins, pa.float64())], names=[*own.schema.names, name])

    return sorted_.mapInArrow(passed, points.select(*by, value, F.lit(0.0).alias(name)).schema)


def template_scores(df: DataFrame, by: list[str], order: list[str | Column], value: str, templates: dict[str, list[float]], keep: list[str]) -> DataFrame:
    """by, keep, template, score: the normalised correlation of each template with the values of the rows that begin at a row, as many as it is long. Rows
    that too few follow, windows with a null, and windows or templates without any spread have none. One window function serves all templates."""
    most = max(map(len, templates.values()))
    ahead = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(*by, *[c for c in keep if c not in by], *[F.lead(F.col(value).cast("double"), k).over(ahead).alias(f"__{k}") for k in range(most)])

    def score(t: list[float]) -> Column:
        n, total, square, dot = len(t), F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for k, w in enumerate(t):
            x = F.col(f"__{k}")
            total, square, dot = total + x, square + x * x, dot + x * F.lit(float(w))
        own = n * sum(w * w for w in t) - sum(t) ** 2
        return F.try_divide(n * dot - total * F.lit(float(sum(t))), F.sqrt(F.greatest(F.lit(0.0), n * square - total * total) * F.lit(float(own))))

    each = F.explode(F.array(*[F.struct(F.lit(name).alias("template"), score(t).alias("score")) for name, t in templates.items()])).alias("s")
    return rows.select(*by, *[c for c in keep if c not in by], each).select(*by, *[c for c in keep if c not in by], "s.*").where("score is not null and not isnan(score)")


def running_means(df: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """by, centre, n, lo, hi: clusters made in one pass over a group's sorted values: a value joins the last cluster if it is `tolerance` at most above that one's mean so far, and
    moves the mean; else it begins another. Equal values are counted before. The pass goes over sorted partitions as they come, so neither many small groups nor a
    large one are held. Nulls and NaN are left out."""
    own = F.col(value).cast("double")
    counted = df.where(own.isNotNull() & ~F.isnan(own)).groupBy(*by, own.alias("__v")).agg(F.count("*").alias("__n"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("__v")) == 1
    kind = counted.select(*by, F.col("__v").alias("centre"), F.col("__n").alias("n"), F.col("__v").alias("lo"), F.col("__v").alias("hi")).schema

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the open cluster, and the row of `by` where it began: row 0 if that was in a batch before
        last, own_row = None, None

        def told(rows: pa.RecordBatch | None, at: list[int], done: list[tuple]) -> pa.RecordBatch:
            keys = [] if rows is None else [rows.column(c).take(pa.array(at, pa.int64())) for c in by]
            sums = [s / n for s, n, _, _ in done], *[[d[k] for d in done] for k in (1, 2, 3)]
            types = pa.float64(), pa.int64(), pa.float64(), pa.float64()
            return pa.RecordBatch.from_arrays([*keys, *map(pa.array, sums, types)], names=[*by, "centre", "n", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, at, done, here = batch.select([*by, "__v"]), [], [], 0
            if own_row is not None:
                rows = pa.Table.from_batches([own_row, rows]).combine_chunks().to_batches()[0]
            shift = rows.num_rows - batch.num_rows
            for k, (v, n, new) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("__v", "__n", "__first")], strict=True)):
                if last is None or new or v - last[0] / last[1] > tolerance:
                    if last is not None:
                        at.append(here)
                        done.append(last)
                    last, here = (v * n, n, v, v), k + shift
                else:
                    last = (last[0] + v * n, last[1] + n, last[2], v)
            own_row = rows.slice(here, 1)
            yield told(rows, at, done)
        if last is not None:
            yield told(own_row, [0], [last])

    return counted.withColumn("__first", first).mapInArrow(passed, kind)


def tail_split(df: DataFrame, by: list[str], order: list[str | Column], share: float, least: int = 1) -> DataFrame:
    """df and `held`: whether a row is among the last ceil(share * n), and `least` at least, of its group's n rows."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("held", place > n - F.greatest(F.lit(least), F.ceil(n * F.lit(share))))
