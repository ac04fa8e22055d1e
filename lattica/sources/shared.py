"""Tables in the folder that all executors share, and reading of the driver's tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast if its rows, written as JSON, take no more than that. JSON is longer than Spark's rows for all but short numbers.
BROADCAST_BYTES = 32 << 20
SALTS = 64
_saved: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of our own on a single machine, an error on a cluster, whose
    executors would each write to their own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, name: str) -> str:
    _saved.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _saved[-1]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = _path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """Like save(), in buckets by a column: groups and joins by that column then read each bucket where it lies, without a shuffle."""
    spark = df.sparkSession
    path = _path(spark, name)
    own = f"lattica_{uuid.uuid4().hex}"
    _tables.append(own)
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).option("compression", "zstd").saveAsTable(own)
    return spark.table(own)


def clear(spark: SparkSession) -> None:
    """Delete what this process saved. Results that were not written or collected yet can't be read after that."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _saved:
        path = jvm.org.apache.hadoop.fs.Path(_saved.pop())
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(), for the small tables of iterations."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fits(small: DataFrame) -> bool:
    """Whether a table is small enough to be broadcast, by its measured size."""
    return (small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def look_up(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", fit: bool | None = None) -> DataFrame:
    """rows with the columns of a table that has few rows for each key; a null key equals a null key. The table is broadcast if its measured
    size allows, so that rows stay where they are; else the join is by key and salt, so that a hot key's rows are dealt to many tasks.
    fit: the answer of fits(), where it is known."""
    small = small.withColumnsRenamed({c: f"__of_{c}" for c in on})
    if fits(small) if fit is None else fit:
        small, dealt = F.broadcast(small), rows
        equal = F.lit(True)
    else:
        small = small.withColumn("__of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        equal = F.col("__salt") == F.col("__of_salt")
    for c in on:
        equal &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return dealt.join(small, equal, how).drop("__salt", "__of_salt", *[f"__of_{c}" for c in on])


def in_order(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """df and each row's place in an order, from 0. Rows are sorted by ranges and saved, and a range begins at the sum of the sizes of those before
    it, so no task sees all rows. Rows that the order does not tell apart are numbered in any order."""
    ordered = save(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftrightunsigned("__id", 33))
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    # a row for each task that wrote
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.col("__id") - F.shiftleft("__part", 33)
    return look_up(ordered, save(before, "before"), ["__part"]).select(*df.columns, (F.col("__before") + within).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
