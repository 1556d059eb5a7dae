"""Order-dependent folds, streamed through groups in order or by windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folded(
    df: DataFrame, group: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]], shape: str
) -> DataFrame:
    """``df`` with the columns of ``shape``: ``step(state, row)`` gives the next state and a row's values.

    Rows stream through in order and each group begins with ``start()``, so a task holds one state
    and one batch, however large its groups. What is sequential by nature stays one task a group.
    ``order`` must end in something unique. Nulls are a group.
    """
    fields = [part.split() for part in shape.split(", ")]
    types = {name: df.schema[name].dataType.simpleString() for name in df.columns}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            told: list[tuple] = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in group)
                if current is None or own != current:
                    current, state = own, start()
                state, values = step(state, row)
                told.append(values)
            columns = [[x[i] for x in told] for i in range(len(fields))]
            arrays = [pa.array(c, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[t]) for c, (_, t) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(n for n, _ in fields)])

    dealt = df.repartition(*group).sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(stream, ", ".join([*(f"`{n}` {t}" for n, t in types.items()), shape]))


def chunked(df: DataFrame, group: Sequence[str], order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """``df`` with the column chunk, from 0 per group: rows in order, a new chunk where the next row
    would exceed the number or the size. A row that is too large alone has a chunk of its own."""

    def step(state: tuple[int, int, int], row: dict) -> tuple[tuple[int, int, int], tuple[int]]:
        chunk, n, held = state
        if n and (n >= most_items or held + row[size] > most_size):
            chunk, n, held = chunk + 1, 0, 0
        return (chunk, n + 1, held + row[size]), (chunk,)

    return folded(df, group, [order], lambda: (0, 0, 0), step, "chunk int")


def token_bucket(df: DataFrame, group: Sequence[str], at: str, order: Sequence[str], most: int, refill_s: int) -> DataFrame:
    """``df`` with passed: a bucket per group holds ``most`` tokens, gains one every ``refill_s`` seconds
    and loses one to each row that finds one. ``at`` are seconds."""

    def step(state: tuple[float, int | None], row: dict) -> tuple[tuple[float, int], tuple[bool]]:
        held, last = state
        held = float(most) if last is None else min(float(most), held + (row[at] - last) / float(refill_s))
        passed = held >= 1
        return (held - 1 if passed else held, row[at]), (passed,)

    return folded(df, group, order, lambda: (float(most), None), step, "passed boolean")


def one_at_a_time(df: DataFrame, group: Sequence[str], at: str, order: Sequence[str], lasts_s: int) -> DataFrame:
    """``df`` with status: 202 where a row starts a run of so many seconds, 409 where its group has one."""

    def step(busy: int | None, row: dict) -> tuple[int, tuple[int]]:
        if busy is not None and row[at] < busy:
            return busy, (409,)
        return row[at] + lasts_s, (202,)

    return folded(df, group, order, lambda: None, step, "status int")


def polled(df: DataFrame, group: Sequence[str], at: str, order: Sequence[str], value: str, every_s: int) -> DataFrame:
    """``df`` with polled and good: a row is a chance to poll, taken once ``every_s`` seconds have gone
    since the last good poll; a null ``value`` is a failed one, and good is the last one that wasn't."""

    def step(state: tuple[int | None, float | None], row: dict) -> tuple[tuple, tuple[bool, float | None]]:
        last, good = state
        due = last is None or row[at] - last >= every_s
        if due and row[value] is not None:
            last, good = row[at], row[value]
        return (last, good), (due, good)

    return folded(df, group, order, lambda: (None, None), step, "polled boolean, good double")


def running_offsets(df: DataFrame, group: Sequence[str], order: Sequence[str], size: Column, align: int) -> DataFrame:
    """``df`` with the column offset: aligned sizes before it within its group."""
    padded = (F.ceil(size / align) * align).cast("long")
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(padded).over(before), F.lit(0)).cast("long"))


def normalized_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str, wrap: tuple[str, str]) -> DataFrame:
    """Conversations in which only the leading turns are of the system.

    Each later run of system turns is wrapped and merged: into the user turn right before it, else
    ahead of the next user turn, else it becomes a user turn itself. Text parts are joined by blank
    lines. Turn numbers stay those of the turn that takes the text.
    """
    order = W.partitionBy(conversation).orderBy(turn)
    system = F.col(role) == "system"
    rows = turns.withColumn("_lead", F.bool_and(system).over(order)).withColumn("_late", system & ~F.col("_lead"))
    run_starts = (F.col("_late") & ~F.coalesce(F.lag("_late").over(order), F.lit(False))).cast("int")
    rows = rows.withColumn("_run", F.sum(run_starts).over(order))
    ahead = order.rowsBetween(1, W.unboundedFollowing)
    back = order.rowsBetween(W.unboundedPreceding, -1)
    own = F.struct(F.col(turn).alias("t"), F.col(role).alias("r"))
    rows = rows.withColumns(
        {
            "_before": F.last(F.when(~F.col("_late"), own), ignorenulls=True).over(back),
            "_next_user": F.first(F.when(F.col(role) == "user", F.col(turn)), ignorenulls=True).over(ahead),
        }
    )
    merged = rows.where("_late").groupBy(conversation, "_run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, text))), lambda x: x[text]), "\n\n").alias("_text"),
        F.min(turn).alias("_first"),
        F.min_by("_before", turn).alias("_before"),
        F.max_by("_next_user", turn).alias("_next_user"),
    )
    into_before = F.col("_before.r") == "user"
    target = F.when(into_before, F.col("_before.t")).otherwise(F.coalesce("_next_user", "_first"))
    side = F.when(into_before, 1).otherwise(-1)
    wrapped = F.concat(F.lit(wrap[0]), F.col("_text"), F.lit(wrap[1]))
    notes = merged.select(conversation, target.alias(turn), side.alias("_side"), F.col("_first").alias("_at"), wrapped.alias(text))
    stays = rows.where("not _late").select(conversation, turn, role, F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_at"), text)
    parts = stays.unionByName(notes.withColumn(role, F.lit(None).cast("string")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_side", "_at", text))), lambda x: x[text]), "\n\n")
    return parts.groupBy(conversation, turn).agg(F.coalesce(F.max(role), F.lit("user")).alias(role), joined.alias(text))
