"""Projections of events on tables and streams against loops."""

import collections
import datetime
import random

from pyspark.sql import functions as F

from lattica.plans.projections import SILENCE, STEPS
from lattica.streaming import projections

START = datetime.datetime(2024, 1, 1)
KIND = "event_id long, user_id long, ts timestamp, event_type string, value double, phase string"


def _events():
    r = random.Random(3)
    rows = [(k, r.randrange(6), START + datetime.timedelta(minutes=10 * k + r.randrange(10)), r.choice(["view", "click", "purchase", "other"]), float(r.randrange(100)), "p") for k in range(400)]
    rows += [(900, 77, START, "view", 1.0, "p"), (901, 77, START + datetime.timedelta(days=1), "view", 1.0, "p"), (902, 77, START + datetime.timedelta(days=1), "click", None, "p")]
    return [*rows, rows[5], (903, None, START, "view", 1.0, "p"), (904, 1, None, "view", 1.0, "p"), (905, 1, START, None, 1.0, "p")]


def _phases(rows):
    out = collections.Counter()
    known = [x for x in rows if x[1] is not None and x[2] is not None and x[3] is not None]
    for u in {x[1] for x in known}:
        phase, last = "idle", None
        for i, _, at, name, *_ in sorted((x for x in known if x[1] == u), key=lambda x: (x[2], x[0])):
            if last and at - last > SILENCE:
                if phase != "idle":
                    out[(u, last + SILENCE, "idle")] += 1
                phase = "idle"
            onward = STEPS.get((phase, name), phase)
            if onward != phase:
                out[(u, at, onward)] += 1
            phase, last = onward, at
    return out


def test_phases_on_tables_and_streams(spark, tmp_path):
    rows = _events()
    df = spark.createDataFrame(rows, KIND)
    want = _phases(rows)
    got = projections.phases(df, "user_id", "ts", "event_id", "event_type", STEPS, SILENCE)
    assert collections.Counter(map(tuple, got.collect())) == want and any(p == "idle" for _, _, p in want)
    assert projections.phases(df.limit(0), "user_id", "ts", "event_id", "event_type", STEPS, SILENCE).count() == 0
    # files in the order of time, one a batch, and at last one whose time lets all silences end
    ordered = sorted((x for x in rows if x[2] is not None), key=lambda x: (x[2], x[0]))
    for k in range(0, len(ordered), 120):
        spark.createDataFrame(ordered[k : k + 120], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k in (10, 20):
        spark.createDataFrame([(990 + k, 5000, START + datetime.timedelta(days=k), "other", 1.0, "p")], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    frame = projections.streamed_phases(stream, "user_id", "ts", "event_id", "event_type", STEPS, SILENCE, "1 hour")
    frame.writeStream.outputMode("append").format("memory").queryName("phases_seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    seen = collections.Counter(map(tuple, spark.table("phases_seen").collect()))
    more = seen - want
    assert not want - seen and all(p == "idle" for _, _, p in more) and len(more) <= 7  # silences that nothing broke


def test_transcript(spark, tmp_path):
    rows = _events()
    df = spark.createDataFrame(rows, KIND)
    items = collections.defaultdict(list)
    for i, u, at, name, value, _ in rows:
        if None not in (u, at, name):
            items[u, name].append((at, i, value))
    want = collections.Counter()
    for (u, name), own in items.items():
        last = max(own, key=lambda x: ((x[2] or 0) > 50, x[0], x[1]))
        want[(u, name, *min(own, key=lambda x: x[:2])[:2], (last[2] or 0) > 50, last[2], len(own))] += 1
    args = ("user_id", "event_type", "ts", "event_id", F.col("value") > 50, F.col("value"))
    assert collections.Counter(map(tuple, projections.transcript(df, *args).collect())) == want
    df.write.parquet(str(tmp_path / "in"))
    stream = projections.transcript(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), *args)
    stream.writeStream.outputMode("complete").format("memory").queryName("transcript_seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert collections.Counter(map(tuple, spark.table("transcript_seen").collect())) == want


def test_phases_of_times_without_a_zone(spark):
    rows = _events()
    df = spark.createDataFrame(rows, KIND).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = projections.phases(df, "user_id", "ts", "event_id", "event_type", STEPS, SILENCE)
    assert got.schema["at"].dataType.simpleString() == "timestamp_ntz" and collections.Counter(map(tuple, got.collect())) == _phases(rows)
