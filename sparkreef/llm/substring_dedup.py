"""Removal of repeated byte strings: a string of ``length`` bytes stays where it occurs first.

Whole texts that a smaller document has too are settled first, by their hashes, and take no further
part: what they hold, the first of them holds. Anchors keep the rest of the work in proportion to
the text. A window of ``length`` bytes is represented by its least ``gram``-byte hash, the last one
of several, so equal windows have an equal anchor at an equal place, whatever surrounds them, and
only one position in eighteen or so is one. A first pass over hashes alone finds the anchors that
several documents share; a second gathers, for those, the bytes of the windows that they represent,
settles equal ones of a batch on the spot, and sorts these contexts by anchor.

Among contexts of one anchor, equal ones are settled as they stream by: all but the first
document's are repeated throughout, and where the first document has one several times, what is
found for it later holds at each of its places. What remains, one context of each kind, is suffix-sorted, to
the right of the anchor and reversed to the left, by mergesort: two suffixes are compared by a
binary search for their common extension over prefix polynomial hashes. Contexts whose extensions
on both sides add up to a window are cut into windows, these are sorted in the same way, and runs
of windows that agree, checked byte by byte since hashes may collide, are held against the first
document that has them.

Anchors that over ``crowd`` documents share would make one group too large for a task's memory;
their windows travel one by one instead, each as a context that is equal to others or not, and
stream by. That path is as exact.

Texts are UTF-8 bytes, null is empty, and matches don't cross documents. All null ids count as one,
the largest long there is. Rows that share an id are one document when it comes to who is first, and keep their own spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.llm.common import BATCH_BYTES, text_hash

LENGTH = 50
GRAM = 16
CROWD = 1 << 15

#: Contexts are sorted in blocks of about so many.
BLOCK = 1 << 14

#: Anchors are found in pieces of about so many bytes, or one text.
PIECE = 1 << 15

_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes (a power of two), by doubling: 32 bits, which choose anchors."""
    h, span = data.astype(np.uint32) + np.uint32(1), 1
    while span < gram:
        h = h[:-span] * np.uint32(pow(_BASE, span, 1 << 32)) + h[span:]
        span *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(15))


def gram_keys(data: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """What anchors are shuffled by: 48 bits of a hash of the ``gram`` bytes at ``places`` tell them apart
    well enough, as bytes are compared later."""
    wide = min(gram, 8)
    words = np.ndarray(len(data) - wide + 1, f"<u{wide}", data, strides=(1,))
    h = np.zeros(len(places), np.uint64)
    for i in range(0, gram, wide):
        h = mixed(h * np.uint64(_BASE) + words[places + i])
    return (h >> np.uint64(16)).view(np.int64)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least (or largest) of each ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int, gram: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, keys, first, last): anchors, and the first and last window that each represents.

    ``ends`` tells where texts end, if ``data`` holds several: no window crosses them.
    """
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    least = sliding(hashes, width, np.minimum)
    crossing = (np.zeros(0, np.int64) if ends is None else ends)[:, None] - np.arange(1, length)
    crossing = crossing[(crossing >= 0) & (crossing < len(least))]
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint32)
    padded[width - 1 : width - 1 + len(least)] = least
    padded[width - 1 + crossing] = 0
    places = np.flatnonzero(sliding(padded, width, np.maximum) == hashes)
    cut = np.ones(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=cut[1:-1])
    cut[crossing] = cut[crossing + 1] = True
    begin, end = np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:])
    if len(crossing):
        inside = np.ones(len(least), bool)
        inside[crossing] = False
        begin, end = begin[inside[begin]], end[inside[end]]
    if not len(begin):
        return none
    again = np.full(len(places), 2 * len(data))  # where the same hash comes next, if a window can hold both: no other anchor lies between
    twin = np.flatnonzero(hashes[places[1:]] == hashes[places[:-1]])
    again[twin] = places[twin + 1]
    # The windows that have an anchor's hash as their least and hold it are part of one run.
    run, value, begin = np.searchsorted(end, places - (width - 1)), hashes[places], np.append(begin, len(data))
    while len(wrong := np.flatnonzero((begin[run] <= places) & (least[np.minimum(begin[run], len(least) - 1)] != value))):
        run[wrong] += 1
    first = np.maximum(begin[run], places - (width - 1))
    last = np.minimum(np.append(end, -1)[run], np.minimum(places, again - width))
    used = first <= last
    places = places[used]
    return places, gram_keys(data, places, gram), first[used], last[used]


class Texts:
    """Texts end to end, gone through in pieces of whole texts that fit a core's cache."""

    def __init__(self, raws: list[bytes]):
        self.raw = b"".join(raws)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.end = np.cumsum([len(x) for x in raws], dtype=np.int64)
        self.start = self.end - [len(x) for x in raws]

    def pieces(self) -> Iterator[tuple[int, int]]:
        """(from, to) of texts, each of PIECE bytes or so and no more than PIECE texts."""
        begin = 0
        while begin < len(self.end):
            upto = int(np.searchsorted(self.end, self.start[begin] + PIECE, "left")) + 1
            yield begin, (upto := min(upto, begin + PIECE, len(self.end)))
            begin = upto

    def anchors(self, begin: int, upto: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """(text, key, places, first, last) of a piece; the three are places in ``data``."""
        at = int(self.start[begin])
        ends = self.end[begin:upto] - at
        places, keys, first, last = anchors(self.data[at : at + int(ends[-1])], length, gram, ends[:-1])
        return np.searchsorted(ends, places, "right") + begin, keys, places + at, first + at, last + at


def of_text(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys of 48 bits, told apart by text."""
    return text.astype(np.uint64) << np.uint64(48) | keys.view(np.uint64)


class Suffixes:
    """Byte strings of one buffer, compared through prefix polynomial hashes.

    ``ahead`` is the buffer itself or, to compare backwards, the buffer reversed.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        n = len(data) + 1
        powers = np.full(n, _BASE, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], dtype=np.uint64, out=self.prefix[1:])

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes agree from ``a`` and ``b`` on, ``most`` at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        pa_, pb, xa, xb = self.prefix[a], self.prefix[b], self.powers[a], self.powers[b]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.prefix[a + mid] - pa_) * xb == (self.prefix[b + mid] - pb) * xa
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of strings."""
        most = np.minimum(a_len, b_len)
        n = self.common(a, b, most)
        last = len(self.data) - 1
        one = np.where(n < most, self.data[np.minimum(a + n, last)], 0).astype(np.int64)
        two = np.where(n < most, self.data[np.minimum(b + n, last)], 0).astype(np.int64)
        return np.where(n < most, np.sign(one - two), np.sign(a_len - b_len))

    def sort(self, start: np.ndarray, length: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order of strings within segments; ``segment`` ascends and stays as it is.

        Bottom-up mergesort of all segments at once: an element's place in a merged run is its
        place in its own plus the number of elements of the other run before it.
        """
        n = len(start)
        order = np.arange(n)
        if not n:
            return order
        first = np.searchsorted(segment, segment, "left")
        end = np.searchsorted(segment, segment, "right")
        width = 1
        while width < int((end - first).max()):
            at = np.flatnonzero(end - first > width)
            place = at - first[at]
            run = place // width
            other = first[at] + (run ^ 1) * width
            low, high = np.minimum(other, end[at]), np.minimum(other + width, end[at])
            begin, right = low.copy(), run & 1
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) // 2
                x, y = order[at[live]], order[mid]
                sign = self.compare(start[y], length[y], start[x], length[x])
                before = np.where(right[live] == 1, sign <= 0, sign < 0)
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
                live = live[low[live] < high[live]]
            target = first[at] + (run // 2) * 2 * width + (place - run * width) + (low - begin)
            moved = order.copy()
            moved[target] = order[at]
            order = moved
            width *= 2
        return order

    def neighbours(self, start: np.ndarray, length: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """For each string, the longest beginning that it shares with another one of its segment."""
        order = self.sort(start, length, segment)
        a, b = order[:-1], order[1:]
        inside = segment[a] == segment[b]
        a, b = a[inside], b[inside]
        shared = self.common(start[a], start[b], np.minimum(length[a], length[b]))
        best = np.zeros(len(start), np.int64)
        np.maximum.at(best, a, shared)
        np.maximum.at(best, b, shared)
        return best


def repeated_windows(
    contexts: list[bytes], left: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(context, place) of windows that a context of the same group has from a smaller document.

    ``left`` is the anchor's place in its context; ``group`` ascends.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ahead = Suffixes(data)
    right_reach = ahead.neighbours(start + left, sizes - left, group)
    behind = Suffixes(data[::-1].copy())
    left_reach = behind.neighbours(len(data) - start - left, left, group)
    able = np.flatnonzero(left_reach + right_reach >= length)
    if len(able) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The windows that a match may reach, by the anchor's place in them.
    low = np.maximum(left[able] - left_reach[able], 0)
    high = np.minimum(left[able], left[able] + right_reach[able] - length)
    counts = np.maximum(high - low + 1, 0)
    owner = np.repeat(able, counts)
    place = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(owner):
        return owner, place
    offset = left[owner] - place
    classes = np.lexsort((doc[owner], offset, group[owner]))
    owner, place, offset = owner[classes], place[classes], offset[classes]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (group[owner][1:] != group[owner][:-1]) | (offset[1:] != offset[:-1])
    segment = np.cumsum(fresh)
    at = start[owner] + place
    order = ahead.sort(at, np.full(len(at), length), segment)
    owner, place, at, segment = owner[order], place[order], at[order], segment[order]
    same = np.zeros(len(at), bool)
    maybe = np.flatnonzero(segment[1:] == segment[:-1])
    agree = ahead.common(at[maybe], at[maybe + 1], np.full(len(maybe), length)) == length
    maybe = maybe[agree]
    steps = np.arange(length)
    true = (data[at[maybe][:, None] + steps] == data[at[maybe + 1][:, None] + steps]).all(1)
    same[maybe[true] + 1] = True
    run = np.cumsum(~same) - 1
    least = np.full(int(run[-1]) + 1, _LAST)
    np.minimum.at(least, run, doc[owner])
    late = doc[owner] > least[run]
    return owner[late], place[late]


def packed_text(text: str) -> Column:
    """A column's texts, compressed each by itself, as they are shuffled. A function of one column, not
    of rows, so that Spark sees the exchange after it as the same one in each pass."""

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressor = zstandard.ZstdCompressor(level=1)
        for texts in parts:
            yield pd.Series([compressor.compress((x or "").encode()) for x in texts], dtype=object)

    return packed(text)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(hash, doc, salt): each anchor hash of a text once, from (id, doc, salt, rid, packed, settled)."""
    unpacked = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        doc, salt = (batch.column(i).to_numpy() for i in (1, 2))
        live = np.flatnonzero(~batch.column(5).to_numpy(zero_copy_only=False))
        packed = batch.column(4)
        begin = 0
        while begin < len(live):
            raws, held = [], 0
            while begin + len(raws) < len(live) and held < BATCH_BYTES:
                raws.append(unpacked(packed[int(live[begin + len(raws)])].as_py()))
                held += len(raws[-1])
            texts, found, owners = Texts(raws), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in texts.pieces():
                text, keys, *_ = texts.anchors(i, j, length, gram)
                own = of_text(text - i, keys)
                own.sort()
                own = own[np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]]
                found.append(own & np.uint64((1 << 48) - 1))
                owners.append((own >> np.uint64(48)).astype(np.int64) + begin + i)
            begin += len(raws)
            rows = live[np.concatenate(owners)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(found).view(np.int64), doc[rows], salt[rows])], ["hash", "doc", "salt"])


def _shared_rows(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """Of (hash, doc, salt) in order: the rows of hashes that several documents have, and whether
    over ``crowd`` texts do. Rows wait for their hash's verdict, ``crowd`` of them at most."""
    names = ["hash", "doc", "salt", "crowded"]
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    crowded = None  # the hash that is known to be

    def told(columns: list[np.ndarray]) -> pa.RecordBatch:
        hashes, docs, _ = columns
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        ends = np.concatenate([starts[1:], [len(hashes)]])
        known = hashes[starts] == crowded if crowded is not None else np.zeros(len(starts), bool)
        several = (docs[starts] != docs[ends - 1]) | known
        many = (ends - starts > crowd) | known
        keep = np.repeat(several, ends - starts)
        return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in columns), pa.array(np.repeat(many, ends - starts)[keep])], names)

    for batch in batches:
        held = [np.concatenate([c, batch.column(i).to_numpy()]) for i, c in enumerate(held)]
        if not len(held[0]):
            continue
        whole = int(np.searchsorted(held[0], held[0][-1]))
        if whole:
            yield told([c[:whole] for c in held])
            held = [c[whole:] for c in held]
        if len(held[0]) > crowd:
            crowded = held[0][0]
            yield told(held)
            held = [c[:0] for c in held]
    if len(held[0]):
        yield told(held)


#: place is a text's number under its document and salt and where the context starts in its text; number is the
#: anchor's place in the context or, where that is settled and its bytes stay behind, the context's size.
_CONTEXT = pa.schema(
    [("key", pa.int64()), ("doc", pa.int64()), ("salt", pa.int32()), ("place", pa.int64()), ("number", pa.int32()), ("context", pa.binary())]
)
_START_BITS = 40


def spread_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each stretch of ``data``: equal bytes, equal hash."""
    powers, inverse = _powers(1 << max(16, len(data).bit_length()))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64, out=prefix[1:])
    return (prefix[end] - prefix[start]) * inverse[start]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse."""
    both = np.ones((2, n), np.uint64)
    both[0, 1:], both[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
    np.cumprod(both, axis=1, dtype=np.uint64, out=both)
    return both[0], both[1]


class _Contexts:
    """Contexts of a batch's texts: where they begin and end, the anchor's place in them and their key."""

    def __init__(self, raws: list[bytes], wanted: np.ndarray, many: np.ndarray, length: int, gram: int):
        self.texts = Texts(raws)
        order = np.argsort(wanted)
        wanted, many = wanted[order], many[order]
        parts: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint64))]
        for i, j in self.texts.pieces() if len(wanted) else ():
            text, keys, places, first, last = self.texts.anchors(i, j, length, gram)
            mine = of_text(text, keys)
            at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            shared = wanted[at] == mine
            plain, crowded = shared & ~many[at], shared & many[at]
            origin, to = int(self.texts.start[i]), int(self.texts.end[j - 1])
            begin, end = first[plain], last[plain] + length
            hashes = spread_hashes(self.texts.data[origin:to], begin - origin, end - origin)
            parts.append((text[plain], keys[plain], begin, end, places[plain] - begin, hashes))
            for t, a, b in zip(*(x[crowded].tolist() for x in (text, first, last)), strict=True):
                begin = np.arange(a, b + 1)
                windows = (hashlib.blake2b(self.texts.raw[k : k + length], digest_size=8).digest() for k in range(a, b + 1))
                hashes = np.frombuffer(b"".join(windows), "<i8")
                parts.append((np.full(len(begin), t), hashes, begin, begin + length, np.zeros(len(begin), np.int64), hashes.view(np.uint64)))
        self.text, self.key, self.begin, self.end, self.left, self.hash = map(np.concatenate, zip(*parts, strict=True))

    def late(self, doc: np.ndarray) -> np.ndarray:
        """Which of them a smaller document of the batch has, too; ``doc`` is each one's document."""
        size = self.end - self.begin
        kind = self.hash
        for x in (self.key, self.left, size):
            kind = mixed(kind * np.uint64(_BASE) + x.view(np.uint64))
        order = np.lexsort((doc, kind))
        fresh = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])[: len(order)]
        head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        maybe = (doc[head] < doc[order]) & (self.key[head] == self.key[order]) & (self.left[head] == self.left[order]) & (size[head] == size[order])
        one, two, raw = order[maybe], head[maybe], self.texts.raw
        places = zip(*(x.tolist() for x in (self.begin[one], self.end[one], self.begin[two], self.end[two])), strict=True)
        same = np.fromiter((raw[a:b] == raw[c:d] for a, b, c, d in places), bool, len(one))
        out = np.zeros(len(order), bool)
        out[one[same]] = True
        return out


def _context_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the shared anchors, from (id, doc, salt, rid, packed, settled, shared): a window each where
    crowded. Of equal contexts in a batch the first document's goes on; the others are settled, so
    their bytes stay behind and they are dealt out by document and salt."""
    unpacked = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        doc, salt, rid = (batch.column(i).to_numpy() for i in (1, 2, 3))
        live = np.flatnonzero(~batch.column(5).to_numpy(zero_copy_only=False))
        packed, lists = batch.column(4), batch.column(6)
        begin = 0
        while begin < len(live):
            raws, held = [], 0
            while begin + len(raws) < len(live) and held <= BATCH_BYTES and len(raws) < 1 << 15:
                raws.append(unpacked(packed[int(live[begin + len(raws)])].as_py()))
                held += len(raws[-1])
            rows = live[begin : begin + len(raws)]
            begin += len(raws)
            own = lists.take(pa.array(rows))
            shared, sizes = own.flatten(), np.diff(own.offsets.to_numpy())
            wanted = of_text(np.repeat(np.arange(len(rows)), sizes), shared.field(0).to_numpy())
            found = _Contexts(raws, wanted, shared.field(1).to_numpy(zero_copy_only=False), length, gram)
            docs, salts = doc[rows][found.text], salt[rows][found.text]
            late = found.late(docs)
            dealt = (docs.view(np.uint64) * np.uint64(_BASE) + salts.astype(np.int64).view(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(1)
            raw = found.texts.raw
            bytes_ = [None if x else raw[a:b] for x, a, b in zip(late.tolist(), found.begin.tolist(), found.end.tolist(), strict=True)]
            columns = (
                np.where(late, dealt.view(np.int64), found.key),
                docs,
                salts,
                rid[rows][found.text] << _START_BITS | found.begin - found.texts.start[found.text],
                np.where(late, found.end - found.begin, found.left),
                bytes_,
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CONTEXT, strict=True)], schema=_CONTEXT)


class _Block:
    """Kinds of contexts, of whole groups, until they are sorted together."""

    def __init__(self):
        self.contexts, self.left, self.group, self.docs = [], [], [], []
        self.places: list[list[tuple[int, int, int]]] = []  # (salt, rid, start) of each time the document has it

    def add(self, group: int, doc: int, salt: int, rid: int, start: int, left: int, context: bytes) -> None:
        self.docs.append(doc)
        self.places.append([(salt, rid, start)])
        self.group.append(group)
        self.left.append(left)
        self.contexts.append(context)

    def again(self, salt: int, rid: int, start: int) -> None:
        """The document of the last kind has it at another place, too."""
        self.places[-1].append((salt, rid, start))

    def spans(self, length: int) -> np.ndarray:
        """Rows (document, salt, rid, start, end)."""
        group = np.array(self.group, np.int64)
        several = np.zeros(len(group), bool)
        same = group[1:] == group[:-1]
        several[1:] |= same
        several[:-1] |= same
        at = np.flatnonzero(several)
        if not len(at):
            return np.zeros((0, 5), np.int64)
        doc = np.array(self.docs, np.int64)[at]
        found, place = repeated_windows([self.contexts[i] for i in at], np.array(self.left)[at], group[at], doc, length)
        runs = joined_spans(np.stack([np.zeros_like(found), np.zeros_like(found), found, place, place + length], 1))
        kinds = at[runs[:, 2]].tolist()
        times = [len(self.places[i]) for i in kinds]
        own = np.array([x for i in kinds for x in self.places[i]], np.int64).reshape(-1, 3)
        begin, end = (np.repeat(runs[:, i], times) + own[:, 2] for i in (3, 4))
        return np.stack([np.repeat(doc[runs[:, 2]], times), own[:, 0], own[:, 1], begin, end], 1)


def joined_spans(rows: np.ndarray) -> np.ndarray:
    """Rows (doc, salt, rid, start, end) in order, those that touch made one. Ends lie below 2^31."""
    rows = rows[np.lexsort(rows.T[3::-1])]
    if not len(rows):
        return rows
    fresh = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])
    own = np.cumsum(fresh) << 31
    reach = np.maximum.accumulate(rows[:, 4] + own)  # ends of a text before lie below any of this one
    apart = fresh.copy()
    apart[1:] |= rows[1:, 3] + own[1:] > reach[:-1]
    at = np.flatnonzero(apart)
    out = rows[at]
    last = np.concatenate([at[1:], [len(rows)]]) - 1
    out[:, 4] = (reach - own)[last]
    return out


def _span_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans, from contexts sorted by key, anchor's place, bytes and document."""
    block, group, head = _Block(), 0, None  # head: (key, left, context, document) of the current kind

    def batch_of(rows: list[np.ndarray]) -> pa.RecordBatch:
        doc, salt, rid, start, end = joined_spans(np.concatenate(rows)).T
        columns = (doc, salt.astype(np.int32), rid, start, end)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["doc", "salt", "rid", "start", "end"])

    for batch in batches:
        docs, salts, places, sizes = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4))
        rids, starts = places >> _START_BITS, places & (1 << _START_BITS) - 1
        settled = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        spans, late = [np.stack([docs, salts, rids, starts, starts + sizes], 1)[settled]], []
        live = np.flatnonzero(~settled)
        contexts = batch.column(5).take(pa.array(live)).to_pylist()
        columns = (batch.column(0).to_numpy(), docs, salts, rids, starts, sizes)
        for key, doc, salt, rid, start, left, context in zip(*(c[live].tolist() for c in columns), contexts, strict=True):
            if head is not None and head[0] == key and head[1] == left and head[2] == context:
                if doc > head[3]:
                    late.append((doc, salt, rid, start, start + len(context)))
                else:
                    block.again(salt, rid, start)
                continue
            if head is None or head[0] != key:
                if len(block.docs) >= BLOCK:
                    spans.append(block.spans(length))
                    block = _Block()
                group += 1
            head = (key, left, context, doc)
            block.add(group, doc, salt, rid, start, left, context)
        yield batch_of([*spans, np.array(late, np.int64).reshape(-1, 5)])
    yield batch_of([block.spans(length)])


def copied_texts(own: DataFrame) -> DataFrame:
    """(doc, salt, copies): for each document with a text that a smaller one has too, the hashes of these."""
    both = own.select("doc", "salt", "rid", F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("rid2"))
    firsts = both.groupBy("rid", "rid2").agg(F.min("doc").alias("first"))
    late = both.join(firsts, ["rid", "rid2"]).where("doc > first")
    return late.groupBy("doc", "salt").agg(F.collect_set("rid").alias("copies"))


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    crowd: int = CROWD,
) -> tuple[DataFrame, DataFrame]:
    """(``docs`` as id, doc, salt, rid, packed, copied and settled; spans by doc and salt).

    packed is the compressed text; copied tells whole texts that a smaller document has, settled also
    all but the first of the rows that repeat one. The second has an array of (rid, start, end) for each
    other document with repeated bytes, unmerged. Texts are dealt out once, by document and salt (32
    bits of the text's hash), so that the rows of an id that many share, or of none, don't meet; each
    pass reads all columns of the first frame, so that Spark takes that exchange again.
    """
    own = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
        F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("salt"),
        text_hash(text_col).alias("rid"),
        F.col(text_col).alias("text"),
    )
    copied = F.coalesce(F.array_contains("copies", F.col("rid")), F.lit(False)).alias("copied")
    packed = own.select("id", "doc", "salt", "rid", packed_text("text").alias("packed"))
    dealt = packed.repartition("doc", "salt").join(copied_texts(own), ["doc", "salt"], "left").select("id", "doc", "salt", "rid", "packed", copied)
    # From here on a text is known by its document, its salt and its place among those that share both.
    among = W.partitionBy("doc", "salt").orderBy("rid")
    repeats = F.coalesce(F.lag("rid").over(among) == F.col("rid"), F.lit(False))
    dealt = dealt.select("id", "doc", "salt", F.dense_rank().over(among).cast("long").alias("rid"), "packed", "copied", (F.col("copied") | repeats).alias("settled"))
    texts = dealt.select("id", "doc", "salt", "rid", "packed", "settled", "copied")
    rows = texts.mapInArrow(lambda b: _anchor_rows(b, length, gram), "hash long, doc long, salt int")
    shared = (
        rows.repartition("hash")
        .sortWithinPartitions("hash", "doc", "salt")
        .mapInArrow(lambda b: _shared_rows(b, crowd), "hash long, doc long, salt int, crowded boolean")
        .repartition("doc", "salt")
        .groupBy("doc", "salt")
        .agg(F.collect_list(F.struct("hash", "crowded")).alias("shared"))
    )
    contexts = (
        dealt.join(shared, ["doc", "salt"])
        .select("id", "doc", "salt", "rid", "packed", "settled", "shared", "copied")
        .mapInArrow(
            lambda b: _context_rows(b, length, gram),
            "key long, doc long, salt int, place long, number int, context binary",
        )
    )
    spans = (
        contexts.repartition("key")
        .sortWithinPartitions("key", "number", "context", "doc")
        .mapInArrow(lambda b: _span_rows(b, length), "doc long, salt int, rid long, start long, end long")
        .repartition("doc", "salt")
        .groupBy("doc", "salt")
        .agg(F.collect_list(F.struct("rid", "start", "end")).alias("spans"))
    )
    return dealt, spans


def removed_runs(spans: list[dict] | None, rid: int) -> list[tuple[int, int]]:
    """A row's spans, merged."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or () if s["rid"] == rid):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in runs:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]])


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    crowd: int = CROWD,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row; kept are the bytes that remain."""
    dealt, spans = repeated_spans(docs, id_col, text_col, length, gram, crowd)
    marked = dealt.join(spans, ["doc", "salt"], "left").select("id", "doc", "rid", "packed", "copied", "spans", "settled", "salt")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for rid, packed, copied, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                raw = unpacked(packed)
                runs = removed_runs(found, rid)
                if copied:
                    runs = [(0, len(raw))] if len(raw) >= length else []
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in runs))
                counts.append(len(runs))
                kept.append(without(raw, runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    id_type = dealt.schema["id"].dataType.simpleString()
    return marked.mapInArrow(cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed(
        "id", id_col
    )
