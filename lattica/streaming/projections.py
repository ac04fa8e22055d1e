"""What streams of events come to, on streams and tables alike: items by first sight with their last word, and the phases that a key goes through.

Defined cases: rows with a null key, item, time or name are left out; rows of the same time go by their id; repeated rows change nothing but counts; an empty
table gives an empty result; other columns are not read."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The phase before the first event and after a silence; what is kept of a key is dropped then.
IDLE = "idle"
_STATE = "phase string, last timestamp, millis long"


def transcript(events: DataFrame, key: str, item: str, at: str, event_id: str, final: Column, value: Column) -> DataFrame:
    """key, item, first_at, first_id, final, value, n: each item with its first sight and its last word: of the final ones if there are any, else of all, the latest. An aggregate,
    so tasks keep one row of an item before the shuffle, and a stream (with a watermark on `at`) keeps one row of it as state."""
    known = events.where(F.col(key).isNotNull() & F.col(item).isNotNull() & F.col(at).isNotNull()).withColumns({"__final": F.coalesce(final, F.lit(False)), "__value": value})
    first, last = F.min(F.struct(F.col(at).alias("at"), F.col(event_id).alias("id"))), F.max(F.struct("__final", at, event_id, "__value"))
    out = known.groupBy(key, item).agg(first.alias("__first"), last.alias("__last"), F.count("*").alias("n"))
    return out.select(key, item, F.col("__first.at").alias("first_at"), F.col("__first.id").alias("first_id"), F.col("__last.__final").alias("final"), F.col("__last.__value").alias("value"), "n")


class _Fold:
    """The phase of one key: a step leads from a phase and an event's name to the next phase; other events change nothing."""

    def __init__(self, steps: dict[tuple[str, str], str], silence: datetime.timedelta, phase: str = IDLE, last: datetime.datetime | None = None):
        self.steps, self.silence, self.phase, self.last = steps, silence, phase, last

    def event(self, at: datetime.datetime, name: str) -> list[tuple[datetime.datetime, str]]:
        """The changes of phase that an event brings."""
        out = []
        if self.last is not None and at - self.last > self.silence:
            out += self.silent()
        onward = self.steps.get((self.phase, name), self.phase)
        if onward != self.phase:
            out.append((at, onward))
        self.phase, self.last = onward, at if self.last is None else max(at, self.last)
        return out

    def silent(self) -> list[tuple[datetime.datetime, str]]:
        out = [(self.last + self.silence, IDLE)] if self.phase != IDLE else []
        self.phase = IDLE
        return out


def _known(events: DataFrame, key: str, at: str, event_id: str, name: str) -> DataFrame:
    return events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(event_id).alias("id"), F.col(name).alias("name"))


def _kind(events: DataFrame, key: str, at: str) -> str:
    return f"key {events.schema[key].dataType.simpleString()}, at {events.schema[at].dataType.simpleString()}, phase string"


def phases(events: DataFrame, key: str, at: str, event_id: str, name: str, steps: dict[tuple[str, str], str], silence: datetime.timedelta) -> DataFrame:
    """key, at, phase: every change of a key's phase; one to IDLE where nothing happened for longer than `silence` and something did after that. Rows are folded as they come
    from sorted partitions, so of a key with very many events no more is held than of any other. Times, with a zone or without, stay what they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, fold = None, None
        for pdf in batches:
            out = []
            for k, when, what in zip(pdf["key"].tolist(), pdf["at"].tolist(), pdf["name"].tolist(), strict=True):
                if fold is None or k != own:
                    own, fold = k, _Fold(steps, silence)
                out += [(k, *x) for x in fold.event(when, what)]
            yield pd.DataFrame(out, columns=["key", "at", "phase"])

    return _known(events, key, at, event_id, name).repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, _kind(events, key, at))


def streamed_phases(events: DataFrame, key: str, at: str, event_id: str, name: str, steps: dict[tuple[str, str], str], silence: datetime.timedelta, late: str) -> DataFrame:
    """As phases(), of a stream, in append mode. A key's state is its phase and last event; once the watermark, which lies `late` behind, has passed the silence after it, the
    change to IDLE is told and the state goes. Events of a batch are folded in their order, those of later batches after them. Times
    without a zone are the session's: a watermark needs one."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            phase, last, _ = state.get
            state.remove()
            told = _Fold(steps, silence, phase, last).silent()
        else:
            phase, last, millis = state.get if state.exists else (IDLE, None, 0)
            fold, told = _Fold(steps, silence, phase, last), []
            rows = sorted(x for pdf in batches for x in zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["name"].tolist(), pdf["millis"].tolist(), strict=True))  # one batch of a key
            for when, _, what, _ in rows:
                told += fold.event(when, what)
            # Spark's own milliseconds, whatever the session's time zone
            millis = max(millis, rows[-1][3])
            state.update((fold.phase, fold.last, millis))
            ends = millis + silence // datetime.timedelta(milliseconds=1) + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(group[0], *x) for x in told], columns=["key", "at", "phase"])

    known = _known(events.withWatermark(at, late), key, at, event_id, name).withColumn("millis", F.unix_millis("at"))
    return known.groupBy("key").applyInPandasWithState(run, _kind(events, key, at), _STATE, "append", GroupStateTimeout.EventTimeTimeout)
