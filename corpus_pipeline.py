"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``. Stages work on all their predecessor kept: documents judged toxic go, lines that an
earlier document holds go, one document of each group of near copies stays, sources are mixed to
their targets (which leaves documents out and repeats others), and what remains is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkreef.llm import line_dedup, mixing, packing, simhash, toxicity
from sparkreef.llm.common import shared_folder, table
from sparkreef.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir, docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack_documents(docs, path("word_bpe_49k.json")).drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express dictionaries, fingerprints or packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the documents of ``sf_dir``.

    A stage's folder goes once the next one is written, so that the shared folder holds two at most, and
    the last one's in the end.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(place(before), True)
        before = path
    return docs
