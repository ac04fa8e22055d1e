"""Queries over events as items and phases."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.streaming import projections

from .registry import query, table

STEPS = {("idle", "view"): "looking", ("looking", "click"): "choosing", ("choosing", "purchase"): "buying", ("looking", "purchase"): "buying", ("buying", "view"): "looking", ("choosing", "view"): "looking"}
SILENCE = datetime.timedelta(hours=6)


@query("transcript", """SELECT user_id, event_type, min(ts) AS first_at, arg_min(event_id, (ts, event_id)) AS first_id, max(value > 50) AS final, arg_max(value, (value > 50, ts, event_id)) AS value, count(*) AS n FROM events GROUP BY user_id, event_type""")
def transcript(spark: SparkSession, d: str) -> DataFrame:
    """Each user's kinds of events by first sight, with the value of the last large one, or of the last if none is."""
    return projections.transcript(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id", F.col("value") > 50, F.col("value"))


@query("phases")
def phases(spark: SparkSession, d: str) -> DataFrame:
    """The phases that users go through; each depends on the one before, so the test compares it with a loop."""
    return projections.phases(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", STEPS, SILENCE)
