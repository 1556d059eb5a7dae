"""A sink for lines that servers pick up: they find the last good whole, whatever becomes of a write.

    spark.dataSource.register(Targets)
    lines.write.format("targets").mode("overwrite").option("path", uri).save()

Tasks write parts under names of their own; the commit, once all have, puts up the list of them, which
is one file that is replaced in one step. A task that fails leaves the list as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sparkreef.sources.bodies import opened

CURRENT = "current.json"


@dataclass
class Part(WriterCommitMessage, InputPartition):
    name: str
    lines: int


def _current(store: fs.FileSystem, path: str) -> dict:
    if store.get_file_info(f"{path}/{CURRENT}").type != fs.FileType.File:
        return {"parts": [], "write": None}
    with store.open_input_stream(f"{path}/{CURRENT}") as stream:
        return json.loads(stream.read())


class TargetsWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri, self.id = uri, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Part:
        store, path = opened(self.uri)
        store.create_dir(path, recursive=True)
        name, n = f"{self.id}-{uuid.uuid4().hex}.prom", 0
        with store.open_output_stream(f"{path}/{name}") as stream:
            for row in iterator:
                stream.write((row[0] + "\n").encode())
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        store, path = opened(self.uri)
        before = _current(store, path)
        parts = [[m.name, m.lines] for m in messages if m and m.lines]
        own = f"{path}/.{self.id}.json"
        with store.open_output_stream(own) as stream:
            stream.write(json.dumps({"parts": parts, "write": self.id}).encode())
        store.move(own, f"{path}/{CURRENT}")
        self._drop(store, path, {name for name, _ in parts} | {name for name, _ in before["parts"]}, "")

    def abort(self, messages: list[Part | None]) -> None:
        store, path = opened(self.uri)
        self._drop(store, path, {name for name, _ in _current(store, path)["parts"]}, self.id)

    def _drop(self, store: fs.FileSystem, path: str, kept: set[str], of: str) -> None:
        """Removes the parts, all or those of one write, that aren't to be kept: readers of the list before go on."""
        for file in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if file.base_name.endswith(".prom") and file.base_name.startswith(of) and file.base_name not in kept:
                store.delete_file(file.path)


class TargetsReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.uri)
        return [Part(name, lines) for name, lines in _current(store, path)["parts"]] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.name:
            store, path = opened(self.uri)
            with store.open_input_stream(f"{path}/{partition.name}") as stream:
                yield from ((line,) for line in stream.read().decode().splitlines())


class Targets(DataSource):
    """One column, line. Writing takes mode overwrite: what is there is replaced as a whole."""

    @classmethod
    def name(cls) -> str:
        return "targets"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> DataSourceReader:
        return TargetsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite or [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("targets are one string column, written with mode overwrite")
        return TargetsWriter(self.options["path"])


def put_up(lines: DataFrame, uri: str) -> None:
    """Replaces the lines at ``uri``; if that fails, they stay as they are."""
    lines.sparkSession.dataSource.register(Targets)
    lines.write.format("targets").mode("overwrite").option("path", uri).save()


def read_targets(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(Targets)
    return spark.read.format("targets").option("path", uri).load()
