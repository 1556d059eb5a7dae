"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording becomes frames of twelve pitch classes. Filters that compare rectangles of the
frames, all summed through one integral image, give two bits each, and sixteen of them one packed
integer for every frame. Recordings with the same integers are one node. A landmark is two
different integers, GAP frames apart; recordings that share one are candidates. A pair of
candidates is aligned: equal integers vote for their offset in a histogram, and at the best offset
the stretch of SPAN frames with the fewest bit errors is looked for. Where it differs in MOST_ERROR
of its bits at most, the two are linked; the connected components are the classes.

Under a landmark each recording first meets the first one and the one before it; then all that are
not connected yet meet, so no candidates are left out. Recordings with a stretch in common, however
many, are connected in the first pass; the second is left with those that share a landmark by
chance. Unrelated melodies differ in a quarter of the bits or more on their best stretch, noisy and
shifted copies in a tenth or less.

A recording that can't be decoded (null, empty or broken bytes) or is too short has no frames and
is a class of its own, without an alignment; so is one whose overlap with any other is under SPAN
frames. Repeated rows are in one class. Null ids name no class unless it has no other.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreef.llm.common import checkpointed, whole_runs
from sparkreef.llm.components import components

RATE = 5512
FRAME = 2048
STEP = 256
LOW, HIGH = 60.0, 2400.0
WIDTH = 16
#: Frames that are transformed at a time.
FRAMES = 16
#: Quantizer steps of a filter's log ratio.
STEPS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: (kind, first pitch class, pitch classes, frames) by a rule: kinds, heights and widths take turns.
FILTERS = tuple((i % 4, (i * 5) % 9, 2 + i % 3 if i % 4 else 3, WIDTH if i % 2 else WIDTH // 2) for i in range(16))
#: Frames between the two integers of a landmark.
GAP = 4
#: Recordings are linked by a stretch of so many frames (2.2 seconds) that differs in no more than this share of its bits.
SPAN = 48
MOST_ERROR = 0.2
#: Pairs go on in batches of about so many.
PAIRS = 100_000


def from_wave(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """(samples, rate) of PCM audio in a RIFF container, mixed down to one channel; else None."""
    try:
        with wave.open(io.BytesIO(data or b"")) as source:
            width, channels, rate = source.getsampwidth(), source.getnchannels(), source.getframerate()
            raw = source.readframes(source.getnframes())
    except (wave.Error, EOFError, OSError, ValueError):
        return None
    if width not in (1, 2, 4) or not channels or not rate:
        return None
    raw = raw[: len(raw) // (width * channels) * width * channels]
    samples = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    samples = (samples - 128) / 128 if width == 1 else samples / (1 << (8 * width - 1))
    return samples.reshape(-1, channels).mean(1), rate


def from_notes(values: list[float] | None) -> tuple[np.ndarray, int] | None:
    """A melody of one tone for each number: an eighth of a second, its pitch by the number's size."""
    if not values:
        return None
    numbers = np.nan_to_num(np.array([0.0 if v is None else v for v in values], np.float64))
    notes = np.clip(np.round(numbers * 60), -18, 18)
    phase = np.cumsum(np.repeat(330.0 * 2.0 ** (notes / 12), RATE // 8))
    phase *= 2 * np.pi
    phase /= RATE
    return np.sin(phase, out=phase), RATE


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    if rate == RATE or not len(samples):
        return samples
    at = np.arange(int(len(samples) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(samples)), samples)


@lru_cache(maxsize=1)
def pitch_bins() -> tuple[slice, np.ndarray, np.ndarray, np.ndarray]:
    """(bins in use; their order by pitch class; where each class begins in that order; the class)."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hertz >= LOW) & (hertz <= HIGH))
    of = np.round(12 * np.log2(hertz[used] / 440.0)).astype(int) % 12
    order = np.argsort(of, kind="stable")
    classes, begin = np.unique(of[order], return_index=True)
    return slice(int(used[0]), int(used[-1]) + 1), order, begin, classes


@lru_cache(maxsize=1)
def frame_buffers() -> tuple[np.ndarray, ...]:
    """The window, and room for FRAMES windowed frames, their spectra and the power of the bins in use."""
    wide = len(pitch_bins()[1])
    return np.hanning(FRAME), np.empty((FRAMES, FRAME)), np.empty((FRAMES, FRAME // 2 + 1), np.complex128), *np.empty((3, FRAMES, wide))


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frame, pitch class), each frame of unit length or zero.

    Sums over bins instead of a matrix product: that one would start threads in every task. A few
    frames at a time, in buffers that stay: spectra of a whole recording would leave a core's cache,
    and their memory would go back and be asked for anew with each of them.
    """
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::STEP]
    bins, order, begin, classes = pitch_bins()
    window, *buffers = frame_buffers()
    found = np.zeros((len(frames), 12))
    for at in range(0, len(frames), FRAMES):
        some = frames[at : at + FRAMES]
        windowed, heard, real, imag, power = (x[: len(some)] for x in buffers)
        np.multiply(some, window, out=windowed)
        np.fft.rfft(windowed, out=heard)
        np.square(heard.real[:, bins], out=real)
        np.square(heard.imag[:, bins], out=imag)
        real += imag
        np.take(real, order, axis=1, out=power, mode="clip")
        found[at : at + FRAMES, classes] = np.add.reduceat(power, begin, axis=1)
    size = np.sqrt((found**2).sum(1, keepdims=True))
    return np.where(size > 1e-6, found / np.maximum(size, 1e-12), 0.0)


def packed(frames: np.ndarray) -> np.ndarray:
    """A uint32 for each run of WIDTH frames, two bits for each filter."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    sums = np.zeros((13, len(frames) + 1))
    sums[1:, 1:] = frames.cumsum(0).cumsum(1).T

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return sums[p1, t1 : t1 + n] - sums[p1, t0 : t0 + n] - sums[p0, t1 : t1 + n] + sums[p0, t0 : t0 + n]

    sides = np.empty((2, len(FILTERS), n))
    for i, (kind, p, high, wide) in enumerate(FILTERS):
        middle, centre = p + high // 2 + high % 2, wide // 2
        whole = area(0, wide, p, p + high)
        if kind == 0:  # these pitch classes against all others
            one, two = whole, (area(0, wide, 0, 12) - whole) * high / (12 - high)
        elif kind == 1:  # lower against upper pitch classes
            one, two = area(0, wide, p, middle), area(0, wide, middle, p + high)
        elif kind == 2:  # before against after
            one, two = area(0, centre, p, p + high), area(centre, wide, p, p + high)
        else:  # a chequerboard
            one = area(0, centre, p, middle) + area(centre, wide, middle, p + high)
            two = whole - one
        sides[:, i] = one, two
    one, two = 1 + np.maximum(sides, 0)
    out = np.zeros(n, np.uint32)
    for level in GRAY[np.searchsorted(STEPS, np.log(one / two))]:
        out = out << np.uint32(2) | level
    return out


def landmarks(prints: np.ndarray) -> np.ndarray:
    """64 bits for each two different integers that stand GAP frames apart, once each."""
    one, two = prints[:-GAP].astype(np.uint64), prints[GAP:].astype(np.uint64)
    return np.unique((one << np.uint64(32) | two)[one != two]).view(np.int64)


def best_offset(one: np.ndarray, two: np.ndarray) -> int | None:
    """The shift of ``two`` against ``one`` that most equal integers vote for."""
    order = np.argsort(two, kind="stable")
    low, high = (np.searchsorted(two[order], one, side) for side in ("left", "right"))
    counts = high - low
    if not counts.sum():
        return None
    mine = np.repeat(np.arange(len(one)), counts)
    theirs = order[np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    votes = np.bincount(mine - theirs + len(two))
    return int(votes.argmax()) - len(two)


def bit_error(one: np.ndarray, two: np.ndarray, offset: int, span: int = SPAN) -> float | None:
    """The least share of bits in which ``span`` frames in a row differ, with ``two`` shifted by
    ``offset``; None where the overlap is shorter."""
    start, end = max(0, offset), min(len(one), len(two) + offset)
    if end - start < span:
        return None
    differing = np.bitwise_count(one[start:end] ^ two[start - offset : end - offset])
    upto = np.concatenate([[0], np.cumsum(differing, dtype=np.int64)])
    return float((upto[span:] - upto[:-span]).min()) / (32 * span)


def fingerprint_media(
    media: DataFrame, id_col: str, media_col: str, decode: Callable[[object], tuple[np.ndarray, int] | None] = from_wave
) -> DataFrame:
    """(id, prints) for each row: the packed integers as an array of ints."""
    source = media.select(F.col(id_col).alias("id"), F.xxhash64(media_col).alias("hash"), F.col(media_col).alias("media"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, known = [], {}  # equal media of a batch are decoded once
            for hash_, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if hash_ not in known or known[hash_][0] != value:
                    sound = decode(value)
                    prints = packed(chroma(resampled(*sound))) if sound else np.zeros(0, np.uint32)
                    known[hash_] = value, prints.view(np.int32)
                found.append(known[hash_][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "prints"])

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(mark, f"id {id_type}, prints array<int>").withColumnRenamed("id", id_col)


def shared_landmarks(nodes: DataFrame) -> DataFrame:
    """(mark, node): the landmarks of ``nodes`` (node, prints) that several have, in order."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [landmarks(np.array(x, np.int32).view(np.uint32)) for x in batch.column(1).to_pylist()]
            owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in marks])
            marks = np.concatenate([*marks, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(owners, pa.int64())], ["mark", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark, node in whole_runs(batches):
            same = mark[1:] == mark[:-1]
            twin = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(mark) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(mark[twin]), pa.array(node[twin])], ["mark", "node"])

    shape = "mark long, node long"
    marked = nodes.select("node", "prints").mapInArrow(spread, shape)
    return marked.repartition("mark").sortWithinPartitions("mark", "node").mapInArrow(shared, shape)


def _pairs(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])


def _met_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (mark, node) in order, each node with its mark's first one and the one before it."""
    for mark, node in whole_runs(batches):
        fresh = np.concatenate([[True], mark[1:] != mark[:-1]])[: len(mark)]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(mark)), 0))
        rest = np.flatnonzero(~fresh)
        yield _pairs(np.concatenate([node[first[rest]], node[rest - 1]]), np.concatenate([node[rest], node[rest]]))


def _met_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (mark, node, root) in order, the pairs of a mark that no links connect yet."""
    for mark, node, root in whole_runs(batches):
        left, step, found, held = np.flatnonzero(mark[1:] == mark[:-1]), 1, [], 0
        while len(left):
            apart = left[root[left] != root[left + step]]
            found.append((node[apart], node[apart + step]))
            held += len(apart)
            if held > PAIRS:
                yield _pairs(*map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
            step += 1
            left = left[left + step < len(mark)]
            left = left[mark[left + step] == mark[left]]
        if held:
            yield _pairs(*map(np.concatenate, zip(*found, strict=True)))


def aligned_pairs(pairs: DataFrame, nodes: DataFrame, span: int, most_error: float) -> DataFrame:
    """(a, b, offset, bit_error): the pairs (a, b) of ``nodes`` (node, prints) that align."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, errors = [], []
            for mine, other in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (x.values.to_numpy().view(np.uint32) for x in (mine, other))
                offset = best_offset(one, two)
                error = None if offset is None else bit_error(one, two, offset, span)
                fits = error is not None and error <= most_error
                offsets.append(offset if fits else None)
                errors.append(error if fits else None)
            told = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(offsets, pa.int64()), pa.array(errors, pa.float64())],
                ["a", "b", "offset", "bit_error"],
            )
            yield told.filter(told.column(2).is_valid())

    of = nodes.select("node", "prints")
    told = pairs.join(of.withColumnsRenamed({"node": "a", "prints": "of_a"}), "a")
    told = told.join(of.withColumnsRenamed({"node": "b", "prints": "of_b"}), "b")
    return told.select("a", "b", "of_a", "of_b").mapInArrow(align, "a long, b long, offset long, bit_error double")


def align_recordings(
    media: DataFrame,
    id_col: str,
    media_col: str,
    decode: Callable[[object], tuple[np.ndarray, int] | None] = from_wave,
    span: int = SPAN,
    most_error: float = MOST_ERROR,
) -> DataFrame:
    """(id, n_prints, class_id, partner_id, offset, bit_error) for each row.

    class_id is the smallest id of the class. partner_id is the recording, other than its equals,
    that the row aligns with best among those it was held against; offset, in steps, shifts the
    partner's prints onto the row's. The three are null where none aligns.
    """
    prints = checkpointed(fingerprint_media(media, id_col, media_col, decode))
    rows = prints.select(F.col(id_col).alias("id"), F.when(F.size("prints") > 0, F.xxhash64("prints")).alias("node"), "prints")
    # Rows with the same prints are one node, named after their hash.
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min("prints").alias("prints"))
    nodes = checkpointed(nodes)
    met = checkpointed(shared_landmarks(nodes))
    pairs = checkpointed(met.mapInArrow(_met_first, "a long, b long").distinct())
    links = checkpointed(aligned_pairs(pairs, nodes, span, most_error))
    roots = components(links)
    rooted = met.join(roots, "node", "left").select("mark", "node", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("mark").agg((F.min("root") < F.max("root")).alias("split")).where("split").select("mark")
    rooted = rooted.join(split, "mark").repartition("mark").sortWithinPartitions("mark", "node")
    rest = checkpointed(rooted.mapInArrow(_met_all, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = checkpointed(links.union(aligned_pairs(rest, nodes, span, most_error)))
        roots = components(links)
    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("partner"), "offset", "bit_error").union(
        links.select("b", "a", -F.col("offset"), "bit_error")
    )
    partners = both.join(named.select(F.col("node").alias("partner"), F.col("least").alias("partner_id")), "partner")
    best = partners.groupBy("node").agg(F.min(F.struct("bit_error", "partner_id", "offset")).alias("best"))
    told = named.join(classes, "root").join(best, "node", "left").select("node", "class_id", "best")
    return rows.join(told, "node", "left").select(
        F.col("id").alias(id_col),
        F.size("prints").cast("long").alias("n_prints"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.col("best.partner_id").alias("partner_id"),
        F.col("best.offset").alias("offset"),
        F.col("best.bit_error").alias("bit_error"),
    )
