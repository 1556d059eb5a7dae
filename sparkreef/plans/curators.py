"""Curators as table functions: any function over a batch of items, with a plain listing where it fails."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf


def curated(items: DataFrame, batch: Sequence[str], order: Sequence[str], key: str, curate: Callable[[list[Row]], Iterable[tuple]], shape: str) -> DataFrame:
    """(key, the columns of ``shape``, curated, problem) for each item.

    ``curate`` gets the rows of one batch, in order, and gives (key, *values) of those it has something
    to say about; the first word on an item counts, words on items that aren't there don't. Items it
    leaves out are listed with nulls and curated false. Where it raises, the whole batch is listed
    like that, each with the problem, and other batches go on.

    Batches are partitions of a TABLE argument: Spark deals them out and sorts them, and a task holds
    one at a time, so they are to be of a bounded size.
    """
    columns = [part.strip().split() for part in shape.split(",")]
    kind = items.schema[key].dataType.simpleString()
    none = (None,) * len(columns)

    class Curator:
        def __init__(self):
            self.rows = []

        def eval(self, row: Row):
            self.rows.append(row)

        def terminate(self):
            problem, said = None, {}
            try:
                for found, *values in curate(self.rows):
                    if len(values) != len(columns):
                        raise ValueError(f"{len(values)} values for {len(columns)} columns")
                    said.setdefault(found, tuple(values))
            except Exception as raised:  # noqa: BLE001  a curator's failure is told in its batch's rows
                problem, said = f"{type(raised).__name__}: {raised}", {}
            for row in self.rows:
                values = said.get(row[key])
                yield (row[key], *(values or none), values is not None, problem)

    spark, name = items.sparkSession, f"curate_{uuid.uuid4().hex}"
    shown = ", ".join([f"`{key}` {kind}", *(f"`{n}` {t}" for n, t in columns), "curated boolean", "problem string"])
    spark.udtf.register(name, udtf(Curator, returnType=shown))
    view = f"items_{uuid.uuid4().hex}"
    items.createOrReplaceTempView(view)
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    return spark.sql(f"SELECT * FROM {name}(TABLE({view}) PARTITION BY {quoted(batch)} ORDER BY {quoted(order)})")
