"""Limits over a stream: token buckets whose state is two numbers a client."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(requests: DataFrame, client: str, at: str, unique: str, most: int, refill_s: int) -> DataFrame:
    """(client, unique, passed): a bucket holds ``most`` tokens, gains one every ``refill_s`` seconds and
    loses one to each request that finds one.

    Requests of a batch are taken in order of time; one from before the last that was seen gains nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else (float(most), None)
        rows = pd.concat(list(parts)).sort_values(["at", "unique"], kind="stable")
        passed = []
        for seconds in rows["at"]:
            if last is not None:
                held = min(float(most), held + max(0, seconds - last) / float(refill_s))
            last = seconds if last is None else max(last, seconds)
            passed.append(held >= 1)
            held -= passed[-1]
        state.update((float(held), int(last)))
        yield pd.DataFrame({"client": key[0], "unique": rows["unique"], "passed": passed})

    told = requests.select(
        F.col(client).cast("string").alias("client"),
        F.col(unique).cast("long").alias("unique"),
        F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000).alias("at"),
    )
    return told.groupBy("client").applyInPandasWithState(
        step, "client string, unique long, passed boolean", "held double, last long", "append", GroupStateTimeout.NoTimeout
    )
