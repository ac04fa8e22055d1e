"""Text tables: previews, exact profiles, reading into and writing from tables.

Defined cases: an empty file has no header, no rows and no lines; short rows end in nulls; blank cells are nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.shared import in_order


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text, named by the header; quoted cells may hold separators and line ends."""
    return spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"', mode="PERMISSIVE")


def preview(spark: SparkSession, path: str, n: int, separator: str = ",") -> DataFrame:
    """The first n rows."""
    return read_csv(spark, path, separator).limit(n)


def profile(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """bytes, lines, rows, columns (names): counted exactly, by Spark's readers. A row may take several lines."""
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    lines = spark.read.text(path).agg(F.count("*").alias("lines"))
    table = read_csv(spark, path, separator)
    rows = table.agg(F.count("*").alias("rows")).withColumn("columns", F.array(*map(F.lit, table.columns)).cast("array<string>"))
    return size.crossJoin(lines).crossJoin(rows)  # one row each


def ends(spark: SparkSession, path: str, n: int) -> DataFrame:
    """part (head, tail), line (from 1), text: the n first and the n last lines of one file, each line once. Lines are numbered by sorted ranges, so no task
    reads all of them; a short file has no tail beside its head."""
    lines = in_order(spark.read.text(path).withColumn("__at", F.monotonically_increasing_id()), ["__at"], "__n").select((F.col("__n") + 1).alias("line"), F.col("value").alias("text"))
    total = lines.agg(F.count("*").alias("__all"))  # one row
    part = F.when(F.col("line") <= n, "head").when(F.col("line") > F.col("__all") - n, "tail")
    return lines.crossJoin(total).select(part.alias("part"), "line", "text").where("part is not null")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Files with a header, columns in the given order."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, columns: list[str]) -> None:
    """A JSON object a line; nulls are written."""
    df.select(*columns).write.mode("overwrite").json(path, ignoreNullFields=False)


def as_dataset(df: DataFrame, name: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """A table as two: dataset, columns, rows (a row); and dataset, row, data (each row as JSON, nulls included, numbered from 0 by an order)."""
    head = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), F.array(*map(F.lit, df.columns)).cast("array<string>").alias("columns"), "rows")
    data = df.select(*[F.col(c) for c in order], F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("__data"))
    rows = in_order(data, [*order, "__data"], "row").select(F.lit(name).alias("dataset"), "row", F.col("__data").alias("data"))
    return head, rows


def from_dataset(rows: DataFrame, schema: str) -> DataFrame:
    """The table of as_dataset()'s rows, by a schema in DDL; in no order."""
    return rows.select(F.from_json("data", schema).alias("d")).select("d.*")
