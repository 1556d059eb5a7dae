"""Phrase mining against counting every phrase of every piece."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkreef.llm import phrases
from sparkreef.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def counted(docs):
    """Counts by (lang, words), and words by language."""
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 6):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts, totals


def mined(docs, least=100, top=2000, inside=100):
    counts, totals = counted(docs)
    found = {k: a for k, a in counts.items() if a >= least}
    rows = {}
    for (lang, words), a in found.items():
        if len(words) < 2:
            continue
        longer = [f for (other, w), f in found.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * f >= inside * a for f in longer):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    out = []
    for lang, best in rows.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def made_docs():
    rng = random.Random(8)
    words = ["red", "RED", "Straße", "straße", "é", "\U0001f600", "a\x00b", "x\xa0y", "\x85", "tab", "on", "off", "K"] + [f"w{i}" for i in range(30)]
    fixed = ["new york city hall steps", "of the of the of the", "A b c d e f g", "one two three", "\U0001f600 � end"]
    docs = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "!\n", "\x0b", "\r\n", ":"]))
        docs.append(("".join(parts), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return docs + [(None, "en"), ("", None), (" . ,", "fr")] + docs[:30]


@pytest.mark.parametrize("shard", [24 << 20, 700, 40])
@pytest.mark.parametrize("least, top, inside", [(20, 2000, 100), (5, 7, 60)])
def test_made_docs(spark, monkeypatch, shard, least, top, inside):
    docs = made_docs()
    docs += [(" ".join(docs[i][0].replace(".", "") for i in range(40) if docs[i][0]), "en")]  # long pieces, to be cut
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    plain = phrases._shards
    monkeypatch.setattr(phrases, "_shards", lambda batches: plain(batches))
    batches = frames(docs)
    if shard < 1000:  # tasks have the module's own size; here the shards themselves are compared
        counts = Counter()
        for s, sign in phrases._shards(batches):
            for n, places, found in s.intervals(5):
                langs, texts = s.phrases(places, n)
                for lang, text, c in zip(langs.to_pylist(), texts.to_pylist(), found.tolist()):
                    counts[lang, text] += sign * c
        wanted = {(lang, " ".join(w)): n for (lang, w), n in counted([(t, "" if x is None else x) for t, x in docs])[0].items() if len(w) > 1}
        assert {k: n for k, n in counts.items() if n} == wanted
        return
    frame = spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(docs)], SCHEMA + ", n long, phrase string").repartition(5)
    rows = sorted(tuple(r) for r in phrases.mine_phrases(frame, least, 5, top, inside).collect())
    assert rows == mined(docs, least, top, inside) and rows


def frames(docs):
    import pyarrow as pa

    return iter([pa.record_batch([pa.array([x or "" for _, x in docs]), pa.array([t for t, _ in docs], pa.string())], ["lang", "text"])])


def test_given_table(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("text", "lang").collect()]
    rows = sorted(tuple(r) for r in QUERIES["op12_phrase_mining"](spark, medium).collect())
    assert rows == mined(docs) and rows


def test_full_bit_table(spark, monkeypatch):
    """Where all bits are set, more is counted and nothing changes."""
    docs = made_docs()
    frame = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], SCHEMA)
    monkeypatch.setattr(phrases, "_bits", lambda keys: np.full(1 << (phrases.FILTER_BITS - 6), 2**64 - 1, np.uint64))
    assert sorted(tuple(r) for r in phrases.mine_phrases(frame, 20).collect()) == mined(docs, 20)


def test_large_counts(spark, monkeypatch):
    """Scores whose factors pass 64 bits."""
    big = 3 * 10**12
    rows = [("en", None, 9 * 10**14), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7)]
    monkeypatch.setattr(phrases, "count_phrases", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, n long"))
    (row,) = phrases.mine_phrases(None).collect()
    assert row.score == 1000 * (big - 7) * 9 * 10**14 // (big * (big + 1))


def test_empty_table(spark, empty):
    assert QUERIES["op12_phrase_mining"](spark, empty).collect() == []


def test_suffix_array():
    rng = random.Random(1)
    words = [rng.randint(0, 2) for _ in range(300)]
    pieces = [rng.randint(1, 9) for _ in range(200)]
    room = [r for p in pieces for r in range(p, 0, -1)][:300]
    room[-1] = 1
    for i in range(298, -1, -1):
        room[i] = min(room[i], room[i + 1] + 1)
    order = phrases.suffix_array(np.array(words), np.array(room), 5)
    suffix = [tuple(words[i : i + min(room[i], 5)]) for i in order]
    assert sorted(order.tolist()) == list(range(300)) and suffix == sorted(suffix)
