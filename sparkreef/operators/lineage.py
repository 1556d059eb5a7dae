"""Cutting lineage where loops would let plans grow with their rounds, and dealing rows out to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` or the context names it.

    Where neither does, a temporary folder on one machine (a local master, as in tests), and an
    error on a cluster: what a machine-local folder holds there is lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Tasks that rows are dealt out to, at least.
TASKS = 64


def dealt(df: DataFrame, *columns: str, tasks: int = TASKS) -> DataFrame:
    """``df`` with rows of equal ``columns`` in one task; without any, in turn.

    The number of tasks is given: ``tasks``, or ``spark.sql.shuffle.partitions`` if that is more. Spark
    doesn't merge them by their size on disk, which tells little of what sorting them or working on them takes.
    """
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)
