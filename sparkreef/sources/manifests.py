"""Tables that are replaced as a whole: data in folders that never change, and numbered manifests that name one.

A version is published by creating its manifest, which only one writer can: others find it taken. A
reader looks up the highest number and reads the folder it names, so that no reader finds the table
missing or half of it, and one that is slow keeps reading the version it began with. Nothing is
renamed but the manifest itself, from a name of its own to its number.

The store must refuse a rename onto a name that is taken, as HDFS and file systems do.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreef.sources.sinks import generated_states, same_rows

FOLDER = "_manifests"


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    entry: dict


class Taken(OSError):
    """Another writer has published the version that this one was to be."""


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions that are published, in order."""
    files, at = file_system(spark, path)
    folder = at(f"{path}/{FOLDER}")
    if not files.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version, by default the last; None where there is none."""
    number = number if number is not None else max(numbers(spark, path), default=0)
    if not number:
        return None
    files, at = file_system(spark, path)
    stream = files.open(at(f"{path}/{FOLDER}/{number:010d}"))
    try:
        entry = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(number, f"{path}/{entry['folder']}", entry)


def create_once(spark: SparkSession, path: str, body: str) -> bool:
    """Creates a file with its whole content, if none lies there; False if one does. Of many at once, one wins."""
    files, at = file_system(spark, path)
    own = at(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(own)
    stream.write(bytearray(body.encode()))
    stream.close()
    try:
        if files.getScheme() == "file":  # a hard link is what a local file system refuses if the name is taken
            try:
                os.link(urlparse(files.makeQualified(own).toString()).path, urlparse(files.makeQualified(at(path)).toString()).path)
                return True
            except FileExistsError:
                return False
        return not files.exists(at(path)) and bool(files.rename(own, at(path)))
    finally:
        files.delete(own, False)


def publish(spark: SparkSession, path: str, number: int, folder: str, **entry) -> Version:
    """Makes ``folder`` (a name within ``path``) version ``number``; raises Taken if another is that already."""
    files, at = file_system(spark, path)
    files.mkdirs(at(f"{path}/{FOLDER}"))
    body = {"folder": folder, **entry}
    if not create_once(spark, f"{path}/{FOLDER}/{number:010d}", json.dumps(body)):
        raise Taken(f"version {number} of {path} is taken")
    return Version(number, f"{path}/{folder}", body)


def _written(df: DataFrame, path: str, kind: str) -> str:
    folder = f"{kind}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def replace(df: DataFrame, path: str, expected: int | None = None, **entry) -> Version:
    """Publishes ``df`` as the version after ``expected`` (by default the last one there is now).

    A writer that derived its rows from a version names it, and gets Taken if that isn't the last any
    more; its data is removed.
    """
    spark = df.sparkSession
    before = expected if expected is not None else max(numbers(spark, path), default=0)
    folder = _written(df, path, "data")
    try:
        return publish(spark, path, before + 1, folder, **entry)
    except Taken:
        files, at = file_system(spark, path)
        files.delete(at(f"{path}/{folder}"), True)
        raise


def replace_if_changed(df: DataFrame, path: str) -> Version | None:
    """``replace``, unless the last version holds the same rows; then None."""
    spark = df.sparkSession
    last = version(spark, path)
    if last and same_rows(spark.read.parquet(last.folder), df):
        return None
    return replace(df, path, last.number if last else 0)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    found = version(spark, path, number)
    if not found:
        raise FileNotFoundError(f"no version of {path} is published")
    return spark.read.parquet(found.folder)


def promote(df: DataFrame, path: str, problems: Callable[[DataFrame], DataFrame]) -> tuple[str, DataFrame | None]:
    """Writes to quarantine, verifies what was written, and only then publishes it.

    ("registered", None), or ("refused", the problems): what fails stays in its folder, which no
    manifest names, and the table is what it was. ``problems`` maps rows to those that are wrong.
    """
    spark = df.sparkSession
    before = max(numbers(spark, path), default=0)
    folder = _written(df, path, "quarantine")
    written = spark.read.parquet(f"{path}/{folder}")
    wrong = problems(written)
    if not wrong.isEmpty():
        return "refused", wrong
    if not same_rows(df, written):
        return "refused", written.limit(0)
    publish(spark, path, before + 1, folder, verified=True)
    return "registered", None


def check_or_write(fresh: DataFrame, path: str, key: str, body: str, write: bool) -> DataFrame:
    """(key, state) of generated files against the last version of ``path``: absent, STALE or ok.

    With ``write``, what isn't ok is written, and the table then holds the fresh bodies beside what else
    was there; where all is ok nothing is. The states are those of this call, whatever follows it.
    """
    spark = fresh.sparkSession
    last = version(spark, path)
    there = spark.read.parquet(last.folder) if last else fresh.limit(0)
    states = generated_states(fresh, there, key, body)
    if write and not states.where("state <> 'ok'").isEmpty():
        kept = there.join(fresh.select(key), key, "left_anti").select(key, body)
        replace(kept.unionByName(fresh.select(key, body)), path, last.number if last else 0)
    return states.withColumn("state", F.when(F.col("state") == "ok", "ok").otherwise("written")) if write else states


def tidy(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all folders that none of the last ``keep`` versions names, and their manifests but the
    last; how many folders went. Not while a writer is at work, whose folder no manifest names yet."""
    files, at = file_system(spark, path)
    found = numbers(spark, path)
    named = {version(spark, path, n).folder.rsplit("/", 1)[-1] for n in found[-keep:]}
    old = [s.getPath() for s in files.listStatus(at(path)) if s.isDirectory() and s.getPath().getName() not in named | {FOLDER}]
    for number in found[:-keep]:
        files.delete(at(f"{path}/{FOLDER}/{number:010d}"), False)
    for folder in old:
        files.delete(folder, True)
    return len(old)
