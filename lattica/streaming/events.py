"""Windows and sequences over event streams; the same functions take streaming and batch DataFrames.

Defined cases: on a stream, what comes later than `late` behind the newest event is dropped by the watermark; a null ts is in no window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total per tumbling window."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of each session: events no farther apart than gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def newest(events: DataFrame, by: str) -> DataFrame:
    """by and the columns of its newest event, ties to the greater event_id: a running aggregate of one row a key on a stream (output mode
    complete or update), a partial aggregate in each task on a table."""
    rest = [c for c in events.columns if c not in (by, "ts", "event_id")]
    return events.groupBy(by).agg(F.max(F.struct("ts", "event_id", *rest)).alias("e")).select(by, "e.*")
