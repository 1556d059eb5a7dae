"""Line dedup over a corpus: a line that several documents hold stays in the first of them.

Lines travel as 128-bit hashes of their keys, never as text. Each map task first combines the
lines of a batch: a key that several documents of the batch hold goes on for the smallest of them
alone, and the others' lines are settled on the spot, so that a line in a third of all documents
reaches the shuffle once a batch. The rest is dealt out by ranges of the hash (hashes are uniform,
so the ranges are cut by arithmetic), sorted within each range by hash, document and position, and
streamed: whatever follows the first document of a hash is dropped. The result is one compressed
bitmap of kept lines for each document that loses any.

A null text counts as one empty line. Keys shorter than ``least`` code points are never dropped. All
null ids count as one, the largest long there is. Rows that share an id count as one document when it comes to who
holds a line; a bitmap belongs to an (id, text) pair, so repeated rows lose the same lines and
rows with one id and different texts don't mix.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreef.llm.common import BLANKS, boxed, partitions, text_hash

LEAST = 10

_BLANKS = BLANKS.encode()
#: Stands for a null id: it sorts last.
_LAST = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    """What makes lines alike: blanks stripped at both ends, A-Z lower-cased."""
    return line.strip(_BLANKS).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _keyed_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Lines of documents (id, text hash, text), combined by key within a batch."""
    for batch in batches:
        owners: dict[bytes, int] = {}
        lines = []
        ids = [_LAST if x is None else x for x in batch.column(0).to_pylist()]
        for doc, rid, text in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts = (text or "").encode().split(b"\n")
            for at, line in enumerate(parts):
                key = line_key(line)
                if _long_enough(key, least):
                    digest = xxhash.xxh3_128_digest(key)
                    if owners.setdefault(digest, doc) > doc:
                        owners[digest] = doc
                    lines.append((digest, doc, rid, at, len(parts)))
        if not lines:
            continue
        settled = np.fromiter((owners[x[0]] != x[1] for x in lines), bool, len(lines))
        halves = np.frombuffer(b"".join(x[0] for x in lines), "<i8").reshape(-1, 2)
        numbers = np.array([x[1:] for x in lines], np.int64)
        # A settled line only has to reach its document: it is dealt out by the document.
        high = np.where(settled, (numbers[:, 1] ^ (numbers[:, 0] * np.int64(-7046029254386353131))), halves[:, 0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(high),
                pa.array(halves[:, 1]),
                pa.array(settled),
                pa.array(numbers[:, 0]),
                pa.array(numbers[:, 1]),
                pa.array(numbers[:, 2].astype(np.int32)),
                pa.array(numbers[:, 3].astype(np.int32)),
            ],
            ["high", "low", "settled", "doc", "rid", "at", "n"],
        )


def _later_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines sorted by hash, document and position: those of all but a hash's first document."""
    owner = None  # (high, low, doc) of the hash that the last batch ended in
    for batch in batches:
        high, low, settled, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        n = len(high)
        if not n:
            continue
        starts = np.ones(n, bool)
        starts[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (settled[1:] != settled[:-1])
        first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        owners = doc[first]
        if owner is not None and not settled[0] and (high[0], low[0]) == owner[:2]:
            owners = np.where(first == 0, owner[2], owners)
        drop = settled | (doc != owners)
        owner = None if settled[-1] else (high[-1], low[-1], owners[-1])
        if drop.any():
            keep = pa.array(drop)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (3, 4, 5, 6)], ["doc", "rid", "at", "n"])


def pack_bitmap(n: int, dropped: list[int]) -> bytes:
    """A compressed bitmap of ``n`` lines, 1 for each that stays."""
    bits = np.ones(n, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def unpack_bitmap(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, rid, n_lines, n_dropped, keep) for each document that loses a line; rid is its text's hash."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_hash(text_col).alias("rid"), F.col(text_col).alias("text"))
    lines = rows.mapInArrow(
        lambda batches: _keyed_lines(batches, least),
        "high long, low long, settled boolean, doc long, rid long, at int, n int",
    )
    place = F.floor(F.shiftrightunsigned("high", 40) * n / (1 << 24))
    dropped = (
        lines.repartitionById(n, place.cast("int"))
        .sortWithinPartitions("settled", "high", "low", "doc", "rid", "at")
        .mapInArrow(_later_lines, "doc long, rid long, at int, n int")
        .groupBy("doc", "rid", "n")
        .agg(F.sort_array(F.collect_set("at")).alias("at"))
    )

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column(3).to_pylist()
            keep = [pack_bitmap(n, at) for n, at in zip(batch.column(2).to_pylist(), lost, strict=True)]
            ids = [None if x == _LAST else x for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    batch.column(1),
                    batch.column(2),
                    pa.array([len(x) for x in lost], pa.int32()),
                    pa.array(keep, pa.binary()),
                ],
                ["doc", "rid", "n_lines", "n_dropped", "keep"],
            )

    return dropped.mapInArrow(bitmaps, "doc long, rid long, n_lines int, n_dropped int, keep binary").withColumnRenamed("doc", id_col)


def kept_text(text: str | None, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text or ""
    lines = (text or "").split("\n")
    return "\n".join(np.array(lines, object)[unpack_bitmap(bitmap, len(lines))])


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(row, keep): each row of ``docs`` as a struct and its bitmap, null where all its lines stay."""
    bitmaps = line_bitmaps(docs, id_col, text_col, least).select(F.col(id_col).alias("doc"), F.col("rid"), F.col("keep"))
    own = boxed(docs, own_doc=F.col(id_col).cast("long"), own_rid=text_hash(text_col))
    return own.join(bitmaps, F.col("own_doc").eqNullSafe(F.col("doc")) & (F.col("own_rid") == F.col("rid")), "left").select("row", "keep")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with its columns, each text without the lines that an earlier document holds.

    Where nothing is dropped the text stays as it is, null included.
    """
    marked = with_bitmaps(docs, id_col, text_col, least)

    @F.pandas_udf("string")
    def cut(text, keep):
        return text.combine(keep, kept_text) if len(text) else text

    text = F.col("row")[text_col]
    left = F.when(F.col("keep").isNull(), text).otherwise(cut(text, "keep"))
    return marked.select(F.col("row").withField(f"`{text_col}`", left).alias("row")).select("row.*")


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) for each row of ``docs``."""
    marked = with_bitmaps(docs.select(id_col, text_col), id_col, text_col, least).select(
        F.col("row")[id_col].alias(id_col), F.col("row")[text_col].alias("text"), "keep"
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, sums = [], [], []
            for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = (text or "").count("\n") + 1
                n_lines.append(n)
                n_dropped.append(0 if keep is None else n - int(unpack_bitmap(keep, n).sum()))
                sums.append(hashlib.sha256(kept_text(text, keep).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sums)],
                [id_col, "n_lines", "n_dropped", "kept_sha256"],
            )

    id_type = marked.schema[id_col].dataType.simpleString()
    return marked.mapInArrow(digest, f"`{id_col}` {id_type}, n_lines long, n_dropped long, kept_sha256 string")
