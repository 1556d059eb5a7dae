"""Binary model headers: magic, counts, typed key-values and tensor descriptions, every length checked
before it is used. Files are read a row each; what is malformed becomes an error in the row."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC = b"GGUF"
VERSIONS = (2, 3)
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9

MOST_ENTRIES = 1 << 20
MOST_STRING = 64 << 20

HEADER = (
    "struct<version:int,kv:map<string,string>,tensors:array<struct<name:string,shape:array<bigint>,type:int,place:bigint>>,"
    "header_bytes:bigint,error:string>"
)


class Malformed(ValueError):
    pass


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Malformed(f"{n} bytes at {self.at} are beyond the end")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def string(self) -> str:
        n = self.number("<Q")
        if n > MOST_STRING:
            raise Malformed(f"a string of {n} bytes")
        return self.take(n).decode("utf-8", "replace")

    def value(self, kind: int, nested: bool = False):
        if kind in SCALARS:
            return self.number(SCALARS[kind])
        if kind == STRING:
            return self.string()
        if kind == ARRAY and not nested:
            inner, n = self.number("<I"), self.number("<Q")
            if inner in SCALARS and n * struct.calcsize(SCALARS[inner]) > len(self.data) - self.at or n > len(self.data) - self.at:
                raise Malformed(f"an array of {n} values")
            return [self.value(inner, True) for _ in range(n)]
        raise Malformed(f"a value of type {kind}")


def parse_header(data: bytes) -> dict:
    c = Cursor(data)
    try:
        if c.take(4) != MAGIC:
            raise Malformed("another magic")
        version, n_tensors, n_kv = c.number("<I"), c.number("<Q"), c.number("<Q")
        if version not in VERSIONS or max(n_tensors, n_kv) > MOST_ENTRIES:
            raise Malformed(f"version {version} with {n_tensors} tensors and {n_kv} values")
        kv = {}
        for _ in range(n_kv):
            key = c.string()
            if key in kv:
                raise Malformed(f"{key} comes twice")
            kv[key] = json.dumps(c.value(c.number("<I")))
        tensors, names = [], set()
        for _ in range(n_tensors):
            name, dims = c.string(), c.number("<I")
            if name in names or not 1 <= dims <= 4:
                raise Malformed(f"tensor {name}")
            names.add(name)
            shape = [c.number("<Q") for _ in range(dims)]
            tensors.append({"name": name, "shape": shape, "type": c.number("<I"), "place": c.number("<Q")})
        align = int(json.loads(kv.get("general.alignment", "32")))
        if align < 1 or align & (align - 1):
            raise Malformed(f"alignment {align}")
        return {"version": version, "kv": kv, "tensors": tensors, "header_bytes": -(-c.at // align) * align, "error": None}
    except (Malformed, struct.error, TypeError) as problem:
        return {"version": None, "kv": {}, "tensors": [], "header_bytes": None, "error": str(problem)}


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, version, kv, tensors, header_bytes, error) of each file."""

    @F.pandas_udf(HEADER)
    def parsed(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in bodies:
            rows = [parse_header(x) for x in part]
            yield pd.DataFrame({k: [r[k] for r in rows] for k in ("version", "kv", "tensors", "header_bytes", "error")}).astype(
                {"version": "Int32", "header_bytes": "Int64"}
            )

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", parsed("content").alias("h")).select("path", "h.*")
