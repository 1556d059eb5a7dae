"""Phrase mining: contiguous word sequences that stand together more often than their words would.

Each shard (a task's texts, up to SHARD_BYTES at a time) numbers its words, sorts its suffixes by
prefix doubling in numpy and reads n-gram counts off the intervals of the longest-common-prefix
array; Spark deals the shards' counts out by key and merges them. Four passes keep what is merged
small, and none drops a phrase that counts: words; then pairs of words, by hash, among words that are
frequent enough; then threes, by hash, whose pairs are; then phrases whose every three words are.
Between passes goes a bit table of fixed size, in which strangers may collide: a collision lets more
through to be counted, and the last pass counts exactly.

Counts travel packed, a row for each shard and block of keys, so that a count takes about four bytes
in the shuffle. A block's rows are merged one after the other, as they come, into its distinct keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkreef.llm.common import checkpointed, partitions

LONGEST = 5
MIN_COUNT = 100
#: A phrase goes if a longer candidate around it is found in so many per cent of its places.
INSIDE_PERCENT = 100
TOP = 2000

#: Text a shard holds; a longer text is cut into shards of its own.
SHARD_BYTES = 16 << 20

#: Bits of the table between passes, 8 MB. A size, not a limit: fuller tables let more through.
FILTER_BITS = 26

#: Into how many parts a language is dealt before its best phrases are picked from the parts' best.
SALTS = 64

_LETTERS = bytes(range(256)).lower()
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else _LETTERS[c] for c in range(256))
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

#: Bits of a hash by which pairs and threes are counted, and those of them that a packed row holds.
CELL_BITS, PACKED_BITS = 40, 28

#: Counts that are merged at once.
MOST_COUNTS = 4_000_000

_COUNTED = "lang string, phrase string, n long"
_PACKED = "lang string, block int, keys binary, counts binary"


def _cut(data: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """A translated text in parts, each with how it counts.

    Parts end between pieces. Where a piece is longer than a part, the next part begins with the words
    that phrases over the cut need, and these words, which count twice, follow with a count of -1.
    """
    at, context = 0, b""
    while at < len(data) or not at:
        end = len(data)
        if end - at > most:
            piece = data.rfind(b"\n", at + 1, at + most)
            word = data.rfind(b" ", at + 1, at + most)
            later = [x for x in (data.find(b" ", at + most), data.find(b"\n", at + most)) if x >= 0]
            end = piece if piece > 0 else word if word > 0 else min(later, default=len(data))
        part = context + data[at:end]
        yield part, 1
        if context:
            yield context, -1
        if end >= len(data):
            return
        inside = data[end : end + 1] != b"\n"
        context = b" ".join(part.rsplit(b"\n", 1)[-1].rsplit(None, LONGEST - 1)[1 - LONGEST :]) if inside else b""
        at = end


class _Shard:
    """Words of some texts as numbers; ``room`` is how many words a phrase from here can have."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = (data == 32) | (data == 10)
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1))
        starts, ends = edge[::2], edge[1::2]
        piece = np.cumsum(data == 10, dtype=np.int32)[starts]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~blank]))]
        ).dictionary_encode()
        self.words, kinds = words.indices.to_numpy().astype(np.int64), words.dictionary
        names = sorted(set(langs))
        if len(names) > 1:  # a word is another one in another language
            code = {lang: i for i, lang in enumerate(names)}
            first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
            lang = np.array([code[x] for x in langs])[np.searchsorted(first, starts, "right") - 1]
            both = lang * max(len(kinds), 1) + self.words
            met = np.zeros(len(names) * max(len(kinds), 1), bool)
            met[both] = True
            self.words = (np.cumsum(met) - 1)[both]
            lang, word = np.divmod(np.flatnonzero(met), max(len(kinds), 1))
        else:
            lang, word = np.zeros(len(kinds), np.int64), np.arange(len(kinds))
        self.lang_of = pa.array(names, pa.string()).take(pa.array(lang))
        self.word_of = kinds.take(pa.array(word)).cast(pa.large_string()).cast(pa.string())
        self._room(np.append(piece[1:] != piece[:-1], True) if len(piece) else np.zeros(0, bool))

    def _room(self, last: np.ndarray) -> None:
        """From whether each word is the last that a phrase can have; words that stand alone go."""
        first = np.append(True, last[:-1]) if len(last) else last
        ends = np.where(last, np.arange(len(last)), len(last))
        self.room = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(last)) + 1
        self.alone = first & last

    def _only(self, kept: np.ndarray) -> None:
        self.words, self.room, self.alone = self.words[kept], self.room[kept], self.alone[kept]

    def hashes(self) -> np.ndarray:
        """One hash per kind of word."""
        return word_hashes(self.lang_of, self.word_of)

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """The hash of each word with the next one, which the last word lacks."""
        h = hashes[self.words]
        key = (h[:-1] * _SPREAD[0] + h[1:]) * _SPREAD[1]
        return key ^ (key >> np.uint64(29))

    def threes(self, hashes: np.ndarray) -> np.ndarray:
        """The hash of each word with the next two, which the last two lack."""
        key = (self.pairs(hashes)[:-1] * _SPREAD[1] + hashes[self.words[2:]]) * _SPREAD[0]
        return key ^ (key >> np.uint64(31))

    def break_at_words(self, passes: np.ndarray) -> None:
        """Phrases don't reach over words that don't pass."""
        kept = passes[self.words]
        last = self.room == 1
        last[:-1] |= ~kept[1:]
        self._room(last | ~kept)
        self._only(kept)
        self._only(~self.alone)

    def break_at_pairs(self, passes: np.ndarray) -> None:
        last = self.room == 1
        last[:-1] |= ~passes
        self._room(last)
        self._only(~self.alone)

    def short_of_threes(self, passes: np.ndarray) -> None:
        """Phrases have room for more than two words only where each three in a row passes."""
        if len(self.words) < 3:
            return
        open_at = np.append(passes & (self.room[:-2] > 2), [False, False])
        ends = np.where(open_at, len(self.words), np.arange(len(self.words)))
        run = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(self.words))
        self.room = np.where(self.room > 1, run + 2, self.room)

    def intervals(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 2 words on: a place of each phrase, and how often it occurs."""
        order = suffix_array(self.words, self.room, longest)
        if not len(order):
            return
        common = common_prefixes(self.words, self.room, order, longest)
        for n in range(2, longest + 1):
            heads = np.flatnonzero(np.append(True, common < n))
            counts = np.diff(np.append(heads, len(order)))
            enough = self.room[order[heads]] >= n
            yield n, order[heads[enough]], counts[enough]

    def phrases(self, places: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        kinds = [pa.array(self.words[places + k]) for k in range(n)]
        if n == 1:
            return self.lang_of.take(kinds[0]), self.word_of.take(kinds[0])
        return self.lang_of.take(kinds[0]), pc.binary_join_element_wise(*(self.word_of.take(k) for k in kinds), " ")


def suffix_array(words: np.ndarray, room: np.ndarray, longest: int) -> np.ndarray:
    """Places sorted by the words that follow, as far as there is room, at least ``longest`` of them.

    Doubling: where ranks by k words are known, a place's rank by 2k words is that of its own rank and
    the one k words on; a place with no room for these comes first.
    """
    rank, order, k = words.astype(np.int64), np.argsort(words), 1
    while k < longest and len(words):
        further = np.zeros(len(words), np.int64)
        reach = np.flatnonzero(room > k)
        further[reach] = rank[reach + k] + 1
        key = rank * (len(words) + 1 + int(rank.max())) + further
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(words), np.int64)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        k *= 2
    return order


def common_prefixes(words: np.ndarray, room: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """Of each suffix and the next one in order: how many words they share, ``longest`` at most."""
    a, b = order[:-1], order[1:]
    room = np.minimum(room[a], room[b])
    common = np.zeros(len(a), np.int8)
    alike = np.ones(len(a), bool)
    for k in range(longest):
        alike &= room > k
        at = np.flatnonzero(alike)
        alike[at] = words[a[at] + k] == words[b[at] + k]
        common += alike
    return common


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Shard, int]]:
    """(shard, how it counts) of all rows of (lang, text) batches."""
    held: dict[int, list[tuple[str, bytes]]] = {1: [], -1: []}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, data = lang.as_py() or "", (text.as_py() or "").encode().translate(_TABLE)
            for part, counts in _cut(data, SHARD_BYTES):
                held[counts].append((lang, part))
                size += len(part)
                if size >= SHARD_BYTES:
                    yield from ((_Shard(*map(list, zip(*x, strict=True))), n) for n, x in held.items() if x)
                    held, size = {1: [], -1: []}, 0
    yield from ((_Shard(*map(list, zip(*x, strict=True))), n) for n, x in held.items() if x)


def word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (language, word): a polynomial over the bytes, spread over all bits."""
    kinds = langs.dictionary_encode()
    lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in kinds.dictionary.to_pylist()], np.uint64)
    offsets = np.frombuffer(words.cast(pa.large_string()).buffers()[1], np.int64)[: len(words) + 1]
    data = np.frombuffer(words.cast(pa.large_string()).buffers()[2] or b"", np.uint8)[: offsets[-1]].astype(np.uint64) + np.uint64(1)
    sizes = np.diff(offsets)
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _SPREAD[0] | np.uint64(1)), dtype=np.uint64)
    terms = data * powers[np.arange(len(data)) - np.repeat(offsets[:-1], sizes)]
    key = (np.add.reduceat(terms, offsets[:-1]) if len(words) else terms) + lang[kinds.indices.to_numpy()]
    key = (key ^ (key >> np.uint64(32))) * _SPREAD[1]
    return key ^ (key >> np.uint64(29))


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _packed(rows: list[tuple[str | None, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "block", "keys", "counts"])


def _pack_phrases(langs: pa.Array, texts: pa.Array, hashes: np.ndarray, counts: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """Phrases, which hold no line ends, by language and block of their hashes."""
    if not len(texts):
        return
    kinds = langs.dictionary_encode()
    group = kinds.indices.to_numpy().astype(np.int64) * blocks + (hashes >> np.uint64(20)).astype(np.int64) % blocks
    order = np.argsort(group, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
    texts, counts, squeeze = texts.take(pa.array(order)), counts[order].astype("<i8"), zstandard.ZstdCompressor(level=1)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lang, block = divmod(int(group[order[a]]), blocks)
        joined = "\n".join(texts[a:b].to_pylist()).encode()
        rows.append((kinds.dictionary[lang].as_py(), block, squeeze.compress(joined), squeeze.compress(counts[a:b].tobytes())))
    yield _packed(rows)


def _pack_cells(keys: np.ndarray, counts: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """Counts by the first CELL_BITS of their keys: a row holds a block of the first bits, and the others sorted."""
    if not len(keys):
        return
    cells = keys >> np.uint64(64 - CELL_BITS)
    order = np.argsort(cells)
    cells, counts, squeeze = cells[order], counts[order].astype("<i4"), zstandard.ZstdCompressor(level=1)
    high = (cells >> np.uint64(PACKED_BITS)).astype(np.int64)
    low = (cells & np.uint64((1 << PACKED_BITS) - 1)).astype("<u4")
    group = high * blocks >> (CELL_BITS - PACKED_BITS)
    # a row may span several values of the high bits, which then stand before its cells
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(cells))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        values, sizes = np.unique(high[a:b], return_counts=True)
        head = np.concatenate([[len(values)], values, sizes]).astype("<u4").tobytes()
        planes = np.diff(low[a:b], prepend=low.dtype.type(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
        rows.append((None, int(group[a]), squeeze.compress(head + planes), squeeze.compress(counts[a:b].view(np.uint8).reshape(-1, 4).T.tobytes())))
    yield _packed(rows)


def _plane(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _unpack_cells(keys: bytes, counts: bytes) -> pa.Table:
    data = zstandard.decompress(keys)
    n = int(np.frombuffer(data[:4], "<u4")[0])
    values, sizes = np.frombuffer(data[4 : 4 + 8 * n], "<u4").reshape(2, n).astype(np.int64)
    low = np.cumsum(_plane(data[4 + 8 * n :]), dtype=np.uint32).astype(np.int64)
    cells = np.repeat(values, sizes) << PACKED_BITS | low
    return pa.table({"key": cells, "n": _plane(zstandard.decompress(counts)).view("<i4").astype(np.int64)})


def _unpack_phrases(keys: bytes, counts: bytes) -> pa.Table:
    texts = zstandard.decompress(keys).decode().split("\n")
    return pa.table({"key": pa.array(texts, pa.large_string()), "n": np.frombuffer(zstandard.decompress(counts), "<i8")})


def _merged(batches: Iterator[pa.RecordBatch], unpack: Callable) -> Iterator[tuple[str | None, pa.Table]]:
    """The summed counts of each (language, block) of packed rows in order."""
    now, held, size = None, [], 0
    for batch in batches:
        for lang, block, keys, counts in zip(*batch.columns, strict=True):
            own = (lang.as_py(), block.as_py())
            if own != now and held:
                yield now[0], _summed(held)
                held, size = [], 0
            now = own
            held.append(unpack(keys.as_py(), counts.as_py()))
            size += len(held[-1])
            if size >= MOST_COUNTS:
                held = [_summed(held)]
                size = len(held[0]) // 2  # so that merging stays in proportion where few keys repeat
    if held:
        yield now[0], _summed(held)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])


def _enough(table: pa.Table, least: int) -> pa.Table:
    return table.filter(pc.greater_equal(table["n"], least))


def _merge_phrases(least: int, totals: bool) -> Callable:
    """Phrases with enough occurrences; under no phrase, how many words were counted."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, table in _merged(batches, _unpack_phrases):
            found = _enough(table, least)
            texts, n = found["key"].cast(pa.string()).to_pylist(), found["n"].to_pylist()
            if totals:
                texts, n = [*texts, None], [*n, pc.sum(table["n"]).as_py()]
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    return merge


def _merge_cells(least: int) -> Callable:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _merged(batches, _unpack_cells):
            yield pa.record_batch([_enough(table, least)["key"].combine_chunks()], ["key"])

    return merge


def _count_words(blocks: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, sign in _shards(batches):
            n = np.bincount(shard.words, minlength=len(shard.word_of)) * sign
            yield from _pack_phrases(shard.lang_of, shard.word_of, shard.hashes(), n, blocks)

    return count


def _narrowed(batches: Iterator[pa.RecordBatch], words: np.ndarray, pairs: np.ndarray | None) -> Iterator[tuple[_Shard, int, np.ndarray]]:
    """Shards in which phrases end at words, and at pairs, that are too rare."""
    for shard, sign in _shards(batches):
        hashes = shard.hashes()
        shard.break_at_words(_marked(words, hashes))
        if pairs is not None and len(shard.words):
            shard.break_at_pairs(_marked(pairs, shard.pairs(hashes)))
        if len(shard.words):
            yield shard, sign, hashes


def _count_pairs(words: np.ndarray, blocks: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, sign, hashes in _narrowed(batches, words, None):
            keys = shard.pairs(hashes)
            for _, places, n in shard.intervals(2):
                yield from _pack_cells(keys[places], n * sign, blocks)

    return count


def _count_threes(words: np.ndarray, pairs: np.ndarray, blocks: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, sign, hashes in _narrowed(batches, words, pairs):
            if len(shard.words) > 2:
                keys = shard.threes(hashes)
                for k, places, n in shard.intervals(3):
                    if k == 3:
                        yield from _pack_cells(keys[places], n * sign, blocks)

    return count


def _count_phrases(words: np.ndarray, pairs: np.ndarray, threes: np.ndarray, longest: int, blocks: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, sign, hashes in _narrowed(batches, words, pairs):
            if len(shard.words) > 2:
                shard.short_of_threes(_marked(threes, shard.threes(hashes)))
            for k, places, n in shard.intervals(longest):
                langs, texts = shard.phrases(places, k)
                yield from _pack_phrases(langs, texts, word_hashes(langs, texts), n * sign, blocks)

    return count


def _bits(keys: DataFrame) -> np.ndarray:
    """The bit table of a long column, key, of CELL_BITS: one row for each 64 bits with any set, at most 2^FILTER_BITS / 64."""
    at = keys.select(F.shiftrightunsigned("key", CELL_BITS - FILTER_BITS).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


@F.pandas_udf(LongType())
def _word_cell(lang: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series((word_hashes(pa.array(lang, pa.string()), pa.array(word, pa.string())) >> np.uint64(64 - CELL_BITS)).astype(np.int64))


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n): each phrase of 1 to ``longest`` words with at least ``min_count`` occurrences.

    Under a null phrase stands how many words the language has. ``docs`` needs lang (null: und) and
    text (null: empty); texts are cut into pieces at ``.,;:!?`` and line ends, and into words at
    blanks and tabs, with A-Z in lower case. Repeated rows count as often as they stand there.
    """
    spark = docs.sparkSession
    blocks = 2 * partitions(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def merged(count: Callable, merge: Callable, schema: str) -> DataFrame:
        packed = rows.mapInArrow(count, _PACKED)
        return packed.repartition(blocks // 2, "lang", "block").sortWithinPartitions("lang", "block").mapInArrow(merge, schema)

    known = merged(_count_words(blocks), _merge_phrases(min_count, True), _COUNTED)
    known = checkpointed(known.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    words = spark.sparkContext.broadcast(_bits(known.where("phrase is not null").select(_word_cell("lang", "phrase").alias("key"))))
    found = merged(lambda b: _count_pairs(words.value, blocks)(b), _merge_cells(min_count), "key long")
    pairs = spark.sparkContext.broadcast(_bits(found))
    found = merged(lambda b: _count_threes(words.value, pairs.value, blocks)(b), _merge_cells(min_count), "key long")
    threes = spark.sparkContext.broadcast(_bits(found))
    longer = merged(lambda b: _count_phrases(words.value, pairs.value, threes.value, longest, blocks)(b), _merge_phrases(min_count, False), _COUNTED)
    return checkpointed(known.unionByName(longer))


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """The phrases of two words and more that score best in each language, all columns as op12 returns them.

    A phrase's score is that of its weakest cut: ``1000 * a * n / (l * r)``, rounded down, for its
    count a, the counts l and r of the parts and the language's n words; equal cuts fall to the first.
    Phrases inside a longer one that occurs in ``inside_percent`` of their places go. It is enough to
    look one word further: what lies between two phrases is at least as frequent as the longer one.
    Sums and products are exact. Empty tables give no rows; other columns are ignored.
    """
    counted = count_phrases(docs, min_count, longest)
    totals = counted.where("phrase is null").select("lang", F.col("n").alias("total"))
    known = counted.where("phrase is not null")
    split = F.split("phrase", " ")
    several = known.select("lang", "phrase", F.col("n").alias("a"), split.alias("w")).where("size(w) > 1")
    cuts = several.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"),
    )
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(cast(a * 1000 as decimal(19,0)) * cast(total as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("cut"))
    around = several.select(
        "lang",
        F.explode(F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1))).alias("w"),
        F.col("a").alias("longer"),
    )
    around = around.select("lang", F.array_join("w", " ").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(f"longer is null or {inside_percent} * cut.a > 100 * longer")
    kept = kept.select("lang", "phrase", "cut.a", "cut.l", "cut.r", F.col("cut.total").alias("n"), "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(f"rank <= {top}")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.where(f"rank <= {top}").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
