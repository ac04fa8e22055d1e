"""What tables there are, and small looks into them.

Defined cases: no tables give an empty result; names are matched in any case."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, like: str = "") -> DataFrame:
    """name, is_view, columns (name:type, in their order) of the session's current database and its temporary views whose name holds `like`."""
    found = [(t.name, t.tableType in ("TEMPORARY", "VIEW"), [f"{f.name}:{f.dataType.simpleString()}" for f in spark.table(t.name).schema]) for t in spark.catalog.listTables() if like.lower() in t.name.lower()]
    return spark.createDataFrame(sorted(found), "name string, is_view boolean, columns array<string>")


def row_estimate(spark: SparkSession, name: str) -> tuple[int, bool]:
    """The number of rows and whether it is an estimate: what ANALYZE TABLE left in the catalogue, else counted."""
    said = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Statistics'").collect()  # a row at most
    found = re.search(r"(\d+) rows", said[0].data_type) if said else None
    return (int(found[1]), True) if found else (spark.table(name).count(), False)


def inventory(spark: SparkSession, like: str = "") -> DataFrame:
    """tables() with rows and whether those are an estimate."""
    kind = "name string, rows long, is_estimate boolean"
    counts = [(r.name, *row_estimate(spark, r.name)) for r in tables(spark, like).select("name").collect()]  # a row for each table
    return tables(spark, like).join(spark.createDataFrame(counts, kind), "name")


def sample(df: DataFrame, n: int, width: int) -> DataFrame:
    """n rows as text without NUL characters; cells longer than `width` are cut there and end in …."""
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), "\\x00", "")
    return df.limit(n).select(*[F.when(F.length(plain(c)) > width, F.concat(F.substring(plain(c), 1, width), F.lit("…"))).otherwise(plain(c)).alias(c) for c in df.columns])
