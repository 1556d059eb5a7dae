"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text; each window of
a text is compressed with both, and the difference of the lengths tells how much toxic text
explains it. A text's differences, over all its windows, go through a logistic curve that was
calibrated on labelled texts the dictionaries have not seen. Scores are for ODDS of toxic to
ordinary texts, whatever the sample's, so that a threshold asks for the same evidence at any size of
the tables and any share of toxic labels.

Toxic text is ordinary text but for a few words, and zstandard trains for what is frequent: a
dictionary trained on whole toxic texts holds ordinary words, in another choice than the ordinary
one, and the two tell nothing (see the README for figures). So the toxic dictionary is trained on
the words of toxic texts that hold a run of bytes significantly more often in toxic texts than in
others, by a likelihood ratio, and the ordinary content stands before it in the same dictionary, so
that ordinary words cost the same in either.

Training is bounded: at most MOST_TOXIC and MOST_ORDINARY labelled texts (those with the smallest
hashes), none over MOST_CHARS and MOST_TOTAL characters together, are brought to the driver. Scoring
covers every text as a whole.

A null or empty text has one empty window. Rows are scored one by one, so repeated rows score
alike and ids don't matter. Without a text of either label the score is the share of toxic ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TOXIC = 1500
MOST_ORDINARY = 3000
MOST_CHARS = 200_000
MOST_TOTAL = 24_000_000

WINDOW_WORDS = 16
LEVEL = 9
#: Bytes that a match takes at least.
LEAST_MATCH = 5
ORDINARY_BYTES = 30_000
TOXIC_BYTES = 900
#: Lengths of the segments that zstandard's trainer picks, and of the runs it counts.
ORDINARY_SEGMENT, TOXIC_SEGMENT = (48, 8), (32, 6)
#: Words are told apart by runs of so many bytes, eight at most, as a run is a 64-bit number.
RUNS = range(5, 9)
#: A run tells if its share of the toxic texts is so many times that of the others, and if its counts
#: are exp(LEAST_EVIDENCE) times likelier than with one share for all.
LEAST_LIFT = 3.0
LEAST_EVIDENCE = 10.0

THRESHOLD = 0.7
#: Toxic texts to ordinary ones that scores are for.
ODDS = 0.5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def word_runs(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, word): the runs of ``n`` bytes of each word, the blanks around it included, as numbers."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    places = len(data) - n + 1
    if not words or places <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = np.zeros(places, np.uint64)
    for k in range(n):
        runs = runs << np.uint64(8) | data[k : k + places]
    blanks = np.cumsum(data == 32)
    inside = blanks[n - 2 : n - 2 + places] == blanks[:places]  # no blank but at the ends
    return runs[inside], blanks[:places][inside] - 1


def without_copies(texts: Sequence[list[bytes]]) -> list[list[bytes]]:
    """The texts that share none of their four smallest shingle hashes with an earlier one."""
    seen, kept = set(), []
    for words in texts:
        marks = sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:4]
        if not seen.intersection(marks):
            kept.append(words)
        seen.update(marks)
    return kept


def telling_words(toxic: Sequence[list[bytes]], ordinary: Sequence[list[bytes]]) -> list[bytes]:
    """What of each toxic text tells it from ordinary ones, its words that hold a telling run."""
    chosen: list[set[int]] = [set() for _ in toxic]
    for n in RUNS:
        found = [word_runs(words, n) for words in toxic]
        runs, held = np.unique(np.concatenate([np.unique(r) for r, _ in found]), return_counts=True)
        runs, held = runs[held > 1], held[held > 1]
        outside = np.zeros(len(runs), np.int64)
        for words in ordinary:
            own = np.unique(word_runs(words, n)[0])
            outside[np.searchsorted(runs, own[np.isin(own, runs, assume_unique=True)])] += 1
        share, other = held / len(toxic), (outside + 1) / (len(ordinary) + 2)
        rest = (len(toxic) - held) * np.log(np.maximum(1 - share, 1e-300) / (1 - other))
        evidence = held * np.log(share / other) + np.where(share < 1, rest, 0.0)
        telling = runs[(share > LEAST_LIFT * other) & (evidence >= LEAST_EVIDENCE)]
        for of, (own, word) in zip(chosen, found, strict=True):
            of.update(word[np.isin(own, telling)].tolist())
    return [b" " + b"  ".join(words[i] for i in sorted(of)) + b" " for words, of in zip(toxic, chosen, strict=True) if of]


def trained_content(samples: Sequence[bytes], size: int, segment: tuple[int, int]) -> bytes:
    """The content of a zstandard dictionary trained on ``samples``, without its tables; too few
    samples to train on are the content themselves."""
    if sum(map(len, samples)) > 4 * size:
        try:
            trained = zstandard.train_dictionary(size + 300, list(samples), k=segment[0], d=segment[1])
            return trained.as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return b" ".join(sorted(samples, key=len))[-2 * size :]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # of the intercept and the features
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        shape = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
            min_match=LEAST_MATCH,
        )
        made = []
        for content in (self.toxic, self.ordinary):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=shape)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=shape))
        return made[0], made[1]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(features), 1 / (1 + math.exp(-self.weights[0])))
        x = (features - np.array(self.means)) / np.array(self.scales)
        z = self.weights[0] + x @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gains(words: list[bytes], toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window of the text."""
    found = []
    for at in range(0, max(1, len(words)), WINDOW_WORDS):
        window = b" " + b" ".join(words[at : at + WINDOW_WORDS]) + b" "
        found.append(len(ordinary.compress(window)) - len(toxic.compress(window)))
    return np.array(found)


def features_of(saved: np.ndarray) -> list[float]:
    top = np.sort(saved)[::-1]
    return [
        float(top[0]),
        float(top[:3].mean()),
        float(saved.mean()),
        *(float((saved >= n).mean()) for n in (1, 2, 3, 4, 6)),
        *(math.log1p(int((saved >= n).sum())) for n in (2, 3, 4)),
        math.log1p(len(saved)),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the intercept and of each column, by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T * (p * (1 - p)) @ design + penalty, design.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: Sequence[str | None], labels: Sequence[int], odds: float = ODDS) -> Model:
    """A model from labelled texts; of each label, every third text calibrates and the rest train."""
    sides = [[words_of(t) for t, label in zip(texts, labels, strict=True) if label == side] for side in (1, 0)]
    if not all(sides):
        share = (len(sides[0]) + 0.01) / (len(texts) + 0.02)
        return Model(b" ", b" ", (math.log(share / (1 - share)),))
    train = [without_copies([t for i, t in enumerate(side) if i % 3 or len(side) < 3]) for side in sides]
    ordinary_samples = [b" ".join(words) for words in train[1] if words]
    common = trained_content(ordinary_samples, ORDINARY_BYTES, ORDINARY_SEGMENT) or b" "
    own = trained_content(telling_words(*train), TOXIC_BYTES, TOXIC_SEGMENT)
    model = Model(common + own, common, (0.0,))
    toxic, ordinary = model.compressors()
    held = [[t for i, t in enumerate(side) if i % 3 == 0] for side in sides]
    x = np.array([features_of(gains(t, toxic, ordinary)) for side in held for t in side])
    y = np.array([1.0] * len(held[0]) + [0.0] * len(held[1]))
    means, scales = x.mean(0), np.maximum(x.std(0), 1e-3)
    w = fit_logistic((x - means) / scales, y)
    w[0] += math.log(odds) - math.log(len(held[0]) / len(held[1]))
    return Model(model.toxic, model.ordinary, tuple(map(float, w)), tuple(map(float, means)), tuple(map(float, scales)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """A model from a bounded sample of the texts that ``labels`` (id, label) names.

    The sample is drawn from the labels first, so only its texts move. Null ids and labels don't
    count.
    """
    label = F.col(label_col).cast("int")
    known = labels.select(F.col(id_col).alias("id"), label.alias("label")).where("id is not null")
    known = known.withColumn("order", F.xxhash64("id"))

    def sample(value: int, most: int) -> DataFrame:
        return known.where(F.col("label") == value).orderBy("order", "id").limit(most)

    chosen = sample(1, MOST_TOXIC).union(sample(0, MOST_ORDINARY))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample has MOST_TOXIC + MOST_ORDINARY rows at most; their sizes decide how many of them come.
    found = texts.join(F.broadcast(chosen), "id").where(F.length("text") <= MOST_CHARS)
    place = ["order", "id", F.xxhash64("text").alias("hash")]
    sizes = found.select(*place, "label", F.length("text").alias("size")).orderBy("order", "id", "hash")
    room, last = dict.fromkeys((0, 1), MOST_TOTAL // 2), {}
    for r in sizes.limit(2 * (MOST_TOXIC + MOST_ORDINARY)).collect():
        if room[r["label"]] >= 0:
            room[r["label"]] -= r["size"]
            if room[r["label"]] >= 0:
                last[r["label"]] = r["order"]
    within = F.lit(False)
    for label, order in last.items():
        within = within | ((F.col("label") == label) & (F.col("order") <= order))
    rows = found.where(within).select(*place, "text", "label").orderBy("order", "id", "hash")
    rows = rows.limit(2 * (MOST_TOXIC + MOST_ORDINARY)).collect()
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: 0 to 1, higher where toxic is likelier."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary = model.compressors()
        for batch in batches:
            found = [features_of(gains(words_of(t), toxic, ordinary)) for t in batch.column(1).to_pylist()]
            scores = model.score(np.array(found)) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(score, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        toxic, ordinary = model.compressors()
        for texts in parts:
            found = [features_of(gains(words_of(t), toxic, ordinary)) for t in texts]
            yield pd.Series(model.score(np.array(found)) if found else [], dtype="float64")

    return docs.where(score(text_col) < threshold)
