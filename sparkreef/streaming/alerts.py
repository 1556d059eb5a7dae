"""Alerts over a stream: pending once their condition holds, firing once it has held long enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def held_alerts(samples: DataFrame, series: str, at: str, condition: Column, hold_s: int) -> DataFrame:
    """(series, at, state) whenever a series' state changes: pending, firing or ok.

    The state of a series is the time since which its condition has held and the time of its last
    sample; samples of a batch are taken in order of time, and ones older than the last are left
    out. A null condition doesn't hold.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last, told = state.get if state.exists else (None, None, "ok")
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        out = []
        for micros, on in zip(rows["at"], rows["on"], strict=True):
            if last is not None and micros < last:
                continue
            last = int(micros)
            since = None if not on else since if since is not None else last
            now = "ok" if since is None else "firing" if last - since >= hold_s * 1_000_000 else "pending"
            if now != told:
                out.append((key[0], last, now))
                told = now
        state.update((since, last, told))
        yield pd.DataFrame(out, columns=["series", "at", "state"])

    marked = samples.select(
        F.col(series).cast("string").alias("series"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("at"),
        F.coalesce(condition, F.lit(False)).alias("on"),
    )
    return marked.groupBy("series").applyInPandasWithState(
        step, "series string, at long, state string", "since long, last long, told string", "append", GroupStateTimeout.NoTimeout
    )
