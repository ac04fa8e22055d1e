"""Set operations, pages of rows, changes of tables by key, nested values.

Defined cases, unless stated: a null equals a null; an empty table is a table like any other."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import resolve
from lattica.sources.shared import save

#: Spark's functions that call into the JVM or tell of files and the machine.
REACHING = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "session_user", "current_user", "user", "version", "raise_error"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}


def combined(a: DataFrame, b: DataFrame, kind: str, every: bool = False) -> DataFrame:
    """Union, intersection or difference (kind: union, intersect, except) by column names; every: rows count as often as they occur."""
    b = b.select(*a.columns)
    if kind == "union":
        return a.union(b) if every else a.union(b).distinct()
    if kind == "intersect":
        return a.intersectAll(b) if every else a.intersect(b)
    return a.exceptAll(b) if every else a.subtract(b)


def where_present(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Rows that have the given values in those of the columns that the table has."""
    for c, v in values.items():
        if c in df.columns:
            df = df.where(F.col(c) == F.lit(v))
    return df


def page(df: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 in an order, which must tell all rows apart. Spark keeps offset + limit rows of a task at most."""
    return df.orderBy(*order).offset(offset).limit(limit)


def capped_count(df: DataFrame, cap: int) -> DataFrame:
    """n, capped: the number of rows, not counted beyond the cap."""
    return df.select(F.lit(1).alias("one")).limit(cap + 1).agg(F.least(F.count("*"), F.lit(cap)).alias("n"), (F.count("*") > cap).alias("capped"))


def next_version(df: DataFrame, by: list[str], version: str) -> DataFrame:
    """by and the version after the greatest; 1 where there are nulls only."""
    return df.groupBy(*by).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias(version))


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    equal = F.lit(True)
    for c in keys:
        equal &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct(), equal


def inserted(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """df and the rows of new whose key it has not."""
    own, equal = _keyed(df, keys)
    return df.unionByName(new.join(own, equal, "left_anti").select(*df.columns))


def upserted(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of df whose key new has not."""
    own, equal = _keyed(new, keys)
    return df.join(own, equal, "left_anti").unionByName(new.select(*df.columns))


def replaced(df: DataFrame, new: DataFrame, where: Column) -> DataFrame:
    """df without the rows that a condition holds for (those for which it is null stay), and new."""
    return df.where(~F.coalesce(where, F.lit(False))).unionByName(new.select(*df.columns))


def replaced_in_region(df: DataFrame, new: DataFrame, page: object, region: tuple[float, float, float, float]) -> DataFrame:
    """df without the boxes of a page whose centre lies in a region, borders included, and new. Boxes with a null coordinate stay."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return replaced(df, new, (F.col("page") == F.lit(page)) & x.between(region[0], region[2]) & y.between(region[1], region[3]))


def appended(log: DataFrame, new: DataFrame, order: list[str | Column], cap: int) -> DataFrame:
    """The `cap` newest rows of a log and what is added to it, by an order from the newest, which must tell all rows apart. Each task keeps `cap` rows."""
    return log.unionByName(new.select(*log.columns)).orderBy(*order).limit(cap)


def replayed(log: DataFrame, order: list[str | Column], where: Column, scan: int, limit: int) -> DataFrame:
    """The first `limit` rows for which a condition holds among the `scan` newest rows of a log, by an order from the newest, and truncated: whether there
    is more, be it rows behind the scan or matches behind the limit. No row where nothing matches."""
    newest = log.orderBy(*order).limit(scan + 1).withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # scan + 1 rows
    newest = newest.withColumn("__rows", F.count("*").over(Window.partitionBy())).where((F.col("__n") <= scan) & where)
    found = newest.withColumn("__n", F.row_number().over(Window.orderBy("__n"))).withColumn("__found", F.count("*").over(Window.partitionBy()))
    return found.withColumn("truncated", (F.col("__rows") > scan) | (F.col("__found") > limit)).where(F.col("__n") <= limit).drop("__n", "__rows", "__found")


def without_columns(df: DataFrame, system: list[str]) -> DataFrame:
    """df without the columns that are for the system only, by their names in any case; those that it has not are passed over."""
    hidden = {c.lower() for c in system}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in hidden])


def aligned(df: DataFrame, schema: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """df in another schema (DDL), after columns were renamed (old: new): columns that it has not are null, values that the new type can't hold become
    null, columns that the schema has not are left out. A name that would clash after renaming is an error."""
    names = [(renamed or {}).get(c, c) for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("two columns would have one name")
    df = df.toDF(*names)
    have = {c.lower(): c for c in names}
    kinds = T.StructType.fromDDL(schema).fields
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds])


def hinted(df: DataFrame, hints: dict[str, tuple[list[str], str]]) -> DataFrame:
    """df and typed columns (name: aliases and type): the first value, by the order of the aliases, that a column named like one of them holds and the type
    can; null where there is none. Names are compared without case, spaces, hyphens and underscores."""
    added = {}
    for name, (aliases, kind) in hints.items():
        held = [c for c in dict.fromkeys(resolve(df.columns, a) for a in aliases) if c]
        added[name] = F.coalesce(*[F.col(f"`{c}`").try_cast(kind) for c in held]) if held else F.lit(None).cast(kind)
    return df.withColumns(added)


def joined_within(pages: DataFrame, page: str, nodes: str, parts: str, id_: str, parent: str) -> DataFrame:
    """page, node, part (structs): the elements of two arrays of a row that belong together by the node's id and the part's parent; nodes without parts have a
    null one. Nothing of one page meets another; repeated pages are pages each. Null ids match nothing."""
    rows = pages.select(page, F.monotonically_increasing_id().alias("__row"), nodes, parts)
    rows = save(rows, "pages")
    node = rows.select(page, "__row", F.explode(nodes).alias("node")).withColumn("__k", F.col(f"node.{id_}"))
    part = rows.select("__row", F.explode(parts).alias("part")).withColumn("__k", F.col(f"part.{parent}"))
    return node.join(part, ["__row", "__k"], "left").select(page, "node", "part")


def write_partitions(df: DataFrame, path: str, by: list[str], mode: str = "replace") -> None:
    """Write Parquet in folders by columns. mode: append; replace, which rewrites the folders that df has rows for; overwrite, which drops all others."""
    if mode == "replace":
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def unnested(df: DataFrame, values: Column, name: str, keep_empty: bool = False) -> DataFrame:
    """A row for each element of an array; keep_empty: a row with a null for rows without elements."""
    return df.withColumn(name, (F.explode_outer if keep_empty else F.explode)(values))


def merged_maps(base: Column, over: Column) -> Column:
    """Both maps' entries, those of `over` where a key is in both; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.coalesce(F.map_contains_key(b, k), F.lit(False))), b)


def positional(df: DataFrame, picks: list[str | None]) -> DataFrame:
    """The picked columns as text, named c0, c1 and so on; None picks a column of nulls."""
    return df.select(*[(F.lit(None) if c is None else F.col(c)).cast("string").alias(f"c{k}") for k, c in enumerate(picks)])


def _refused(spark: SparkSession, plan) -> str | None:
    """What in a parsed statement could do more than read known tables: commands, functions that are not Spark's own or reach into the machine, and relations that the
    catalogue has not, such as paths. Plans, expressions, subqueries and WITH parts are all walked."""
    jvm = spark._jvm
    kind = lambda name: jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")
    writes = [kind(f"plans.logical.{x}") for x in ("Command", "ParsedStatement")]
    function, table_function, relation, subquery, logical, with_ = (kind(x) for x in ("analysis.UnresolvedFunction", "analysis.UnresolvedTableValuedFunction", "analysis.UnresolvedRelation", "expressions.SubqueryExpression", "plans.logical.LogicalPlan", "plans.logical.UnresolvedWith"))
    own = {r.function for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - REACHING  # a few hundred
    parts = lambda names: [names.apply(k) for k in range(names.size())]
    todo, asked, defined = [plan], [], set()
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in writes):
            return node.nodeName()
        if function.isInstance(node) and parts(node.nameParts())[-1].lower() not in own:
            return ".".join(parts(node.nameParts()))
        if table_function.isInstance(node) and (name := parts(node.name())[-1].lower()) not in TABLE_FUNCTIONS:
            return name
        if relation.isInstance(node):
            asked.append(parts(node.multipartIdentifier()))
        if subquery.isInstance(node):
            todo.append(node.plan())
        if with_.isInstance(node):
            for part in parts(node.cteRelations()):
                defined.add(part._1().lower())
                todo.append(part._2())
        if logical.isInstance(node):
            todo += parts(node.expressions())
        todo += parts(node.children())
    for name in asked:
        if not (len(name) == 1 and name[0].lower() in defined) and not spark.catalog.tableExists(".".join(f"`{x}`" for x in name)):
            return ".".join(name)
    return None


def _reaching(spark: SparkSession, plan) -> str | None:
    """The function of REACHING that an analysed plan calls, within the views that it reads, however deep, too."""
    kind = lambda name: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")
    expression, subquery, logical = (kind(x) for x in ("expressions.Expression", "expressions.SubqueryExpression", "plans.logical.LogicalPlan"))
    parts = lambda names: [names.apply(k) for k in range(names.size())]
    todo, names = [plan], REACHING - {"raise_error"}  # Spark's own checks raise errors
    while todo:
        node = todo.pop()
        if expression.isInstance(node) and node.prettyName() in names:
            return node.prettyName()
        if subquery.isInstance(node):
            todo.append(node.plan())
        if logical.isInstance(node):
            todo += parts(node.expressions())
        todo += parts(node.children())
    return None


def read_only(spark: SparkSession, statement: str, most: int) -> DataFrame:
    """At most `most` rows of one SELECT or WITH statement over tables and views of the catalogue. Spark's own parser tells what it is; anything that would change or
    show state (commands, DDL, DML), call what is not Spark's own function or reaches into the machine, or read a path is refused. So are views, of views too, that call what reaches into
    the machine; functions of users in them are not, as whoever made the view could call them."""
    refused = _refused(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(statement))
    if refused:
        raise ValueError(f"not a query of known tables: {refused}")
    rows = spark.sql(statement)  # analysed, not run
    refused = _reaching(spark, rows._jdf.queryExecution().analyzed())
    if refused:
        raise ValueError(f"a view calls {refused}")
    return rows.limit(most)


def read_only_rows(spark: SparkSession, statement: str, most: int, seconds: float) -> list[Row]:
    """The rows of read_only(), whose jobs are cancelled after that many seconds."""
    group = f"read-only-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context.setJobGroup(group, "read only", interruptOnCancel=True)
    timer = threading.Timer(seconds, context.cancelJobGroup, [group])
    timer.start()
    try:
        return read_only(spark, statement, most).collect()  # `most` rows
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def page_with_total(df: DataFrame, order: list[str | Column], offset: int, limit: int, total: str = "total") -> DataFrame:
    """As page(), with the number of all rows; no row where the page is empty."""
    return page(df, order, offset, limit).crossJoin(df.agg(F.count("*").alias(total)))  # one row
