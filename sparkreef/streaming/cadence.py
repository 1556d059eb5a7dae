"""Polls of many sources at their cadences, with the last good value kept in state and timers for silence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

POLLED = "source string, unique long, at long, polled boolean, good double, stale boolean"


class Cadence(StatefulProcessor):
    """State: when the source was last polled well, what it said, and for when its timer is set. Times are microseconds."""

    def __init__(self, every_s: int, stale_s: int):
        self.every = every_s * 1_000_000
        self.stale = stale_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, good double, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last, good, timer = self.held.get() if self.held.exists() else (None, None, None)
        was = last
        for row in sorted(rows, key=lambda r: (r.micros, r.unique)):
            due = last is None or row.micros - last >= self.every
            if due and row.value is not None:
                last, good = row.micros, row.value
            yield Row(source=key[0], unique=row.unique, at=row.micros, polled=due, good=good, stale=False)
        if last is not None and last != was:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (last + self.stale) // 1000
            self.handle.registerTimer(timer)
            self.held.update((last, good, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last, good, timer = self.held.get()
        if timer == expiredTimerInfo.getExpiryTimeInMs():  # else the source has been polled since
            self.held.update((last, good, None))
            yield Row(source=key[0], unique=None, at=last + self.stale, polled=False, good=good, stale=True)

    def close(self) -> None:
        pass


def polled(chances: DataFrame, source: Column, at: Column, unique: Column, value: Column, every_s: int, stale_s: int, late: str = "0 seconds") -> DataFrame:
    """The rows of POLLED: each row of ``chances`` is a chance to poll its source, taken once ``every_s``
    seconds have gone since the last good poll; a null ``value`` is a failed one, and good is the last
    one that wasn't. Once the watermark passes ``stale_s`` seconds without a good poll, a timer adds a
    row that says so, with the last good value.

    Rows of a batch are taken in order of time. The session needs a state store with column families.
    """
    told = chances.select(
        source.cast("string").alias("source"), at.cast("timestamp").alias("at"), unique.cast("long").alias("unique"), value.cast("double").alias("value")
    )
    told = told.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    rows = told.groupBy("source").transformWithState(Cadence(every_s, stale_s), POLLED, "append", "eventTime")
    return rows.withColumn("at", F.timestamp_micros("at"))


def unstale(rows: DataFrame) -> DataFrame:
    """What the batch fold gives: the chances without the timers' rows."""
    return rows.where(~F.col("stale")).select("source", "unique", "polled", "good")
