"""Tables in the folder that all executors share, and reading of the driver's tables."""

from pyspark.sql import DataFrame

from lattica.sources.shared import cut, fits, look_up, save, save_bucketed, shared_folder, table

__all__ = ["cut", "fits", "look_up", "save", "save_bucketed", "shared_folder", "small_batches", "table", "unclashed"]

#: What Spark hands a Python worker at once, one row at least.
BATCH_BYTES = 8 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, whose session from now on hands Python workers batches of BATCH_BYTES, which bounds what both sides hold of long texts."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return docs


def unclashed(docs: DataFrame, keep: list[str], added: list[str]) -> tuple[DataFrame, list[str]]:
    """docs and the names of the columns to keep, each once; those that an operator adds columns of the same name to end in _input."""
    names = {}
    for c in keep:
        if c in added:
            names[c] = f"{c}_input"
            while names[c] in docs.columns:
                names[c] += "_"
    return docs.withColumnsRenamed(names), [names.get(c, c) for c in dict.fromkeys(keep)]
