"""A log of streams' progress that is only appended to, with each run's end, and its replay from any entry on."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sparkreef.sources import manifests

ENTRY = "seq long, run string, name string, event string, at string, batch long, rows long, observed string, error string"

#: Events after which a run says nothing more.
FINAL = ("finished", "failed")


class ProgressLog(StreamingQueryListener):
    """Appends an entry for each event of the streams it listens to; a file each, which none can replace.

    Numbers go up by one. A second listener on the same folder takes the next number that is free, so
    that entries of both stand in one order. ``observe`` metrics of a batch go into its entry.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path, threading.Lock()
        files, at = manifests.file_system(spark, path)
        files.mkdirs(at(path))
        self.next = max((int(s.getPath().getName().split(".")[0]) for s in files.listStatus(at(path)) if s.getPath().getName()[:1].isdigit()), default=0) + 1

    def append(self, run: str, name: str | None, event: str, at: str | None = None, **more) -> int:
        with self.lock:
            while True:
                entry = {"seq": self.next, "run": run, "name": name, "event": event, "at": at, **more}
                wrote = manifests.create_once(self.spark, f"{self.path}/{self.next:012d}.json", json.dumps(entry))
                self.next += 1
                if wrote:
                    return self.next - 1

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.append(str(event.runId), event.name, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        told = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.append(str(p.runId), p.name, "progress", p.timestamp, batch=p.batchId, rows=p.numInputRows, observed=json.dumps(told, default=str, sort_keys=True))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        failed = event.exception is not None
        self.append(str(event.runId), None, "failed" if failed else "finished", error=event.exception.splitlines()[0] if failed else None)


def replay(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """The entries behind number ``after``, ENTRY; who has read up to one goes on from there."""
    return spark.read.schema(ENTRY).json(f"{path}/[0-9]*.json").where(F.col("seq") > after)


def states(entries: DataFrame, run: str = "run", seq: str = "seq", event: str = "event", final: tuple[str, ...] = FINAL) -> DataFrame:
    """(run, steps, last, ended, ended_at) of an append log: a run's state is its first final entry, else
    its last; entries behind a final one don't count."""
    order = W.partitionBy(run).orderBy(seq)
    over = F.max(F.col(event).isin(*final)).over(order.rowsBetween(W.unboundedPreceding, -1))
    counted = entries.where(F.col(run).isNotNull()).withColumn("_over", F.coalesce(over, F.lit(False))).where("not _over")
    last = counted.groupBy(run).agg(F.count("*").alias("steps"), F.max_by(event, seq).alias("last"), F.max(seq).alias("_at"))
    ended = F.col("last").isin(*final)
    return last.select(run, "steps", "last", ended.alias("ended"), F.when(ended, F.col("_at")).alias("ended_at"))
