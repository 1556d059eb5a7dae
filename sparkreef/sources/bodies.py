"""Sources as a Spark data source: a partition for each source, its failure a row, offsets for streams.

    spark.dataSource.register(Bodies)
    spark.read.format("bodies").option("sources", '{"name": "uri", …}').load()

``folder`` instead of ``sources`` takes each file of a folder as a source of its name. Any store that
pyarrow's file systems reach will do. Executors read; the driver lists names and sizes only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SHAPE = "source string, place int, ok boolean, error string, body string, bytes long"

#: A larger body is an error, as is one that isn't text.
MOST_BYTES = 16 << 20


@dataclass
class Source(InputPartition):
    name: str
    uri: str
    place: int


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _listed(options) -> list[Source]:
    if "sources" in options:
        named = list(json.loads(options["sources"]).items())
    else:
        store, path = opened(options["folder"])
        prefix = options["folder"].rstrip("/")
        files = store.get_file_info(fs.FileSelector(path))
        shown = [f.base_name for f in files if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        named = [(name, f"{prefix}/{name}") for name in sorted(shown)]
    return [Source(name, uri, place) for place, (name, uri) in enumerate(named)]


def _read(part: Source, most: int) -> Iterator[tuple]:
    """One row, whatever happens: other sources go on."""
    try:
        store, path = opened(part.uri)
        info = store.get_file_info(path)
        if info.type != fs.FileType.File:
            raise FileNotFoundError("no such file")
        if info.size > most:
            raise ValueError(f"over {most} bytes")
        with store.open_input_stream(path) as stream:
            data = stream.read()
        if len(data) > most:
            raise ValueError(f"over {most} bytes")
        yield part.name, part.place, True, None, data.decode("utf-8-sig"), len(data)
    except UnicodeDecodeError:
        yield part.name, part.place, False, "not UTF-8", None, None
    except Exception as problem:  # noqa: BLE001  a source's failure is its row
        yield part.name, part.place, False, str(problem).splitlines()[0] if str(problem) else type(problem).__name__, None, None


class BodiesReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.most = options, int(options.get("mostBytes", MOST_BYTES))

    def partitions(self) -> list[InputPartition]:
        return _listed(self.options)

    def read(self, partition: Source) -> Iterator[tuple]:
        return _read(partition, self.most)


class BodiesStream(DataSourceStreamReader):
    """Offsets are what each source's file was last: its time and size. A batch reads the sources that changed."""

    def __init__(self, options):
        self.options, self.most = options, int(options.get("mostBytes", MOST_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        told = {}
        for source in _listed(self.options):
            try:
                store, path = opened(source.uri)
                info = store.get_file_info(path)
                told[source.name] = f"{info.mtime_ns}-{info.size}" if info.type == fs.FileType.File else "missing"
            except Exception as problem:  # noqa: BLE001
                told[source.name] = f"unreachable: {problem}"
        return told

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [s for s in _listed(self.options) if s.name in end and start.get(s.name) != end[s.name]]

    def read(self, partition: Source) -> Iterator[tuple]:
        return _read(partition, self.most)

    def commit(self, end: dict) -> None:
        pass


class Bodies(DataSource):
    """Rows of SHAPE. A batch reads every source, a stream those whose file has changed."""

    @classmethod
    def name(cls) -> str:
        return "bodies"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return BodiesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return BodiesStream(self.options)
