"""Packing token sequences: best-fit decreasing with a segment tree over remaining capacities.

Each task tokenizes its own documents and packs them in shards of a bounded number of tokens, so
nothing is shuffled and a lost task is simply run again with the same result. Within a shard,
documents longer than a window are first cut into full windows; what remains is placed in
decreasing order of length into the tightest open window that takes it, which a segment tree
indexed by remaining capacity finds. Only then do cuts help: pieces of the emptiest windows fill
the gaps of the others, and the one window that stays short is cut at powers of two, where a
sequence needs no padding.

A null text counts as empty. A document always has its end id, so an empty one has one token.
Repeated rows and null ids are packed like any others.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
#: A shard is packed as soon as it holds this many tokens.
SHARD_TOKENS = 1 << 22
#: A worker remembers this many words, and units of them without mark and case, at most.
REMEMBERED_WORDS = 1 << 18
REMEMBERED_UNITS = 1 << 19

PIECES = "id {id}, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed
    in Latin-1 and isn't blank, else the next free one from U+0100."""
    shown = [chr(b) if chr(b).isprintable() and not chr(b).isspace() else None for b in range(256)]
    free = iter(range(256, 512))
    return [x if x is not None else chr(next(free)) for x in shown]


class WordTokenizer:
    """Ids by a tokenizer whose words never span blanks, so each word is encoded once and remembered.

    For such a tokenizer, one that lower-cases, splits letters from punctuation and then takes bytes,
    a word that ends in a mark has the ids of the word and of the mark, and a word of Latin letters
    is one unit of the model, which can be asked without the rest of the tokenizer. All other words
    go through the whole of it.
    """

    MARKS = frozenset(".,;:!?|)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        if word.isalpha() and max(word) < "\u0180" and "\u0130" not in word:
            unit = word.lower()
            if (known := self.units.get(unit)) is not None:
                return known
            letters = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(letters)]
        else:
            unit = word
            if (known := self.units.get(unit)) is not None:
                return known
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        if len(self.units) >= REMEMBERED_UNITS:
            self.units.clear()
        self.units[unit] = found = array("I", ids).tobytes()
        return found

    def _learn(self, word: str) -> None:
        if len(word) > 1 and word[-1] in self.MARKS and word[-2].isalpha() and word[-2] != "\u0130":
            self.words[word] = self._ids(word[:-1]) + self._ids(word[-1])
        else:
            self.words[word] = self._ids(word)

    def encode(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").split(" ")
        missing = set(words).difference(self.words)
        if missing:
            if len(self.words) + len(missing) > REMEMBERED_WORDS:
                self.words.clear()
                missing = set(words)
            for word in missing:
                self._learn(word)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint32)


@lru_cache(maxsize=2)
def tokenizer_at(path: str) -> WordTokenizer:
    """One for all tasks of a worker process."""
    return WordTokenizer(path)


class CapacityTree:
    """Open windows by remaining capacity; finds the least capacity that is enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest (capacity, window) with at least ``least``, taken out."""
        at = least + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.open[capacity].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, window


@dataclass
class Sequence:
    pieces: list[tuple[int, int, int]] = field(default_factory=list)  # document, start, length
    length: int = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.pieces.append((doc, start, length))
        self.length += length


def best_fit(lengths: list[int], window: int) -> list[Sequence]:
    """Best-fit decreasing over documents of these lengths; full windows are cut off first."""
    done: list[Sequence] = []
    rest = []
    for doc, n in enumerate(lengths):
        full = n // window * window
        for start in range(0, full, window):
            done.append(Sequence([(doc, start, window)], window))
        if n > full:
            rest.append((n - full, doc, full))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, windows = CapacityTree(window), []
    for length, doc, start in rest:
        found = tree.take(length)
        if found is None:
            found = (window, len(windows))
            windows.append(Sequence())
        capacity, at = found
        windows[at].add(doc, start, length)
        if capacity > length:
            tree.add(capacity - length, at)
    return done + windows


def fill_gaps(sequences: list[Sequence], window: int) -> list[Sequence]:
    """The same pieces, cut where needed so that each sequence is full or ends at a power of two."""
    full = [s for s in sequences if s.length == window]
    short = sorted((s for s in sequences if s.length < window), key=lambda s: -s.length)
    low, high = 0, len(short) - 1
    while low < high:
        into, give = short[low], short[high]
        doc, start, length = give.pieces[-1]
        moved = min(window - into.length, length)
        into.add(doc, start + length - moved, moved)
        give.length -= moved
        if moved == length:
            give.pieces.pop()
        else:
            give.pieces[-1] = (doc, start, length - moved)
        low += into.length == window
        high -= not give.pieces
    full += [s for s in short if s.length == window]
    for last in (s for s in short if 0 < s.length < window):
        queue = list(reversed(last.pieces))
        left = last.length
        while left:
            size = 1 << (left.bit_length() - 1)
            part = Sequence()
            while part.length < size:
                doc, start, length = queue.pop()
                taken = min(length, size - part.length)
                part.add(doc, start, taken)
                if taken < length:
                    queue.append((doc, start + taken, length - taken))
            full.append(part)
            left -= size
    return full


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``row`` tells the rows of ``docs`` apart where ids repeat: it is unique to a row within its
    sequences' task. ``tokenizer_path`` must be readable on every executor.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        ids, tokens, held = [], [], 0
        next_sequence, next_row = task << 36, task << 36
        id_type = None

        def shard() -> pa.RecordBatch:
            nonlocal next_sequence, next_row, held
            columns = [[] for _ in range(8)]
            for s in fill_gaps(best_fit([len(t) for t in tokens], window), window):
                offset = 0
                for doc, start, length in s.pieces:
                    part = tokens[doc][start : start + length]
                    row = (ids[doc], next_row + doc, start, length, zlib.crc32(part.astype("<u4")), len(tokens[doc]), next_sequence, offset)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                next_sequence += 1
            next_row += len(ids)
            ids.clear()
            tokens.clear()
            held = 0
            names = ["id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.concatenate([tokenizer.encode(text or ""), end])
                ids.append(doc)
                tokens.append(found)
                held += len(found)
                if held >= shard_tokens:
                    yield shard()
        if ids:
            yield shard()

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(pack, PIECES.format(id=id_type)).withColumnRenamed("id", id_col)
