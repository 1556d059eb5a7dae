"""What the corpus operators share: reading tables, cutting lineage, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreef.operators.lineage import checkpointed, shared_folder

__all__ = ["BATCH_BYTES", "BLANKS", "boxed", "checkpointed", "partitions", "shared_folder", "table", "text_hash", "whole_runs"]

#: ASCII white space, as the contracts of the queries define it.
BLANKS = "\t\n\x0b\x0c\r "

#: One Arrow batch holds this many bytes at most (besides its last row), so that a batch of
#: very long texts fits beside the others in an executor.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by a path that only Spark needs to be able to open."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(column: str = "text"):
    """Tells rows with one id and different texts apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one struct column, row, and ``columns`` beside it, whatever names ``docs`` has."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut where its value changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        key = columns[0]
        if not len(key):
            continue
        if held and held[0][0][0] == key[-1]:  # one run that goes on
            held.append(columns)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield [np.concatenate(c) for c in zip(*held, [x[:cut] for x in columns], strict=True)]
        held = [[x[cut:] for x in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]
