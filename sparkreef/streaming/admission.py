"""Admission over a stream of items: per-source cutoffs and what is deferred stay in keyed state.

A trigger is a run. What a run finds new and can't take, for its budget, waits in the state and comes
first, oldest first, in the next one; a source's cutoff moves to the run's time only when the source
succeeded and no further than the oldest of its items that wait. Nothing is read again from
files of runs before: cutoffs, keys and waiting items are in the state store.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Parts that a watch's known keys are kept in: each is looked up once a run, whatever keys of it come.
PARTS = 4096

#: What goes in: an item of a source has a key; a row without one says how the source's fetch ended.
ARRIVALS = "watch string, source string, key string, at timestamp, ok boolean"

#: What comes out: admitted items, then a row for each source's cutoff, then the run's counts.
ADMITTED = "watch string, kind string, source string, key string, at timestamp, cutoff timestamp, sent long, waiting long"


class Admission(StatefulProcessor):
    """A watch's runs. State: cutoff by source, keys taken or waiting, the items that wait. Times are microseconds."""

    def __init__(self, budget: int, look_back_s: int):
        self.budget = budget
        self.look_back = look_back_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cutoffs = handle.getMapState("cutoffs", "source string", "at long")
        self.known = handle.getMapState("known", "part long", "keys array<string>")
        self.waiting = handle.getListState("waiting", "source string, key string, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        watch = key[0]
        arrived, ended = {}, {}
        for row in rows:
            if row.key is None:
                at, ok = ended.get(row.source, (row.at, True))
                ended[row.source] = (max(at, row.at), ok and bool(row.ok))
            else:
                order = (row.at is not None, row.at, row.source)
                if row.key not in arrived or order < arrived[row.key][0]:
                    arrived[row.key] = (order, row)
        if not ended:  # items wait for the word that their fetch has ended
            now = None
        else:
            now = max(at for at, _ in ended.values())
        held = list(self.waiting.get()) if self.waiting.exists() else []
        fresh = []
        cutoffs = {source: self._cutoff(source, now) for source in {row.source for _, row in arrived.values()}}
        parts: dict[int, list[str]] = {}
        for name in arrived:
            parts.setdefault(zlib.crc32(name.encode()) % PARTS, []).append(name)
        for part, names in parts.items():  # one look-up and one update for all keys of a part
            known = list(self.known.getValue((part,))[0]) if self.known.containsKey((part,)) else []
            before, met = len(known), set(known)
            for name in names:
                row = arrived[name][1]
                cutoff = cutoffs[row.source]
                if name not in met and (row.at is None or cutoff is None or row.at >= cutoff):
                    fresh.append((row.source, name, row.at))
                    known.append(name)
            if len(known) > before:
                self.known.updateValue((part,), (known,))
        ready = sorted(held + fresh, key=lambda x: (x[2] is not None, x[2] or 0, x[1])) if now is not None else held + fresh
        sent = ready[: self.budget] if now is not None else []
        left = ready[len(sent) :]
        self.waiting.put([Row(source=s, key=k, at=a) for s, k, a in left]) if left else self.waiting.clear()
        for source, name, at in sent:
            yield Row(watch=watch, kind="item", source=source, key=name, at=at, cutoff=None, sent=None, waiting=None)
        if now is None:
            return
        oldest: dict = {}
        for source, _, at in left:
            if at is not None:
                oldest[source] = min(at, oldest.get(source, at))
        for source in sorted(ended, key=lambda s: (s is not None, s)):
            _, ok = ended[source]
            cutoff = min(now, oldest.get(source, now)) if ok else self._cutoff(source, now)
            self.cutoffs.updateValue((source,), (cutoff,))
            yield Row(watch=watch, kind="cutoff", source=source, key=None, at=None, cutoff=cutoff, sent=None, waiting=None)
        yield Row(watch=watch, kind="run", source=None, key=None, at=now, cutoff=None, sent=len(sent), waiting=len(left))

    def _cutoff(self, source: str | None, now):
        """A source's own cutoff; without one, so far back from the run's time."""
        if self.cutoffs.containsKey((source,)):
            return self.cutoffs.getValue((source,))[0]
        return now - self.look_back if now is not None else None

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """A state store with column families for the streams that are started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def admitted(arrivals: DataFrame, budget: int = 150, look_back_s: int = 30 * 86_400) -> DataFrame:
    """The rows of ADMITTED that a stream of ARRIVALS leads to, a run for each trigger in which a fetch ended.

    First per key wins (the oldest), keys taken or waiting don't come again, items before their source's
    cutoff are left out, undated ones never. A failed source keeps its cutoff; one without any is
    pinned to what it had to go by. A watch's keys and waiting items are the state of one task.
    The stream needs a state store with column families, see ``state_store``.
    """
    rows = arrivals.withColumn("at", F.unix_micros("at"))
    told = rows.groupBy("watch").transformWithState(Admission(budget, look_back_s), ADMITTED.replace("timestamp", "long"), "update", "none")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("at", "cutoff")})


def arrivals(items: DataFrame, watch: Column, source: Column, key: Column, at: Column) -> DataFrame:
    """Items as ARRIVALS."""
    return items.select(
        watch.cast("string").alias("watch"), source.cast("string").alias("source"), key.cast("string").alias("key"), at.cast("timestamp").alias("at"), F.lit(True).alias("ok")
    )
