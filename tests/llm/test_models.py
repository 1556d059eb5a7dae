"""Models applied plainly, and results on repeated rows, null and shared ids, row by row."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

import brute
from sparkreef.llm import toxicity, url_filter
from sparkreef.llm.queries import QUERIES, toxicity_model


def plain_score(model, text):
    """A text's score by compressing each window with both dictionaries, one call each."""
    shape = zstandard.ZstdCompressionParameters.from_level(9, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=5)

    def size(content, window):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=shape).compress(window))

    words = (text or "").lower().encode().split()
    windows = [b" " + b" ".join(words[i : i + 16]) + b" " for i in range(0, len(words), 16)] or [b"  "]
    saved = sorted((size(model.ordinary, w) - size(model.toxic, w) for w in windows), reverse=True)
    n = len(saved)
    over = lambda k: sum(s >= k for s in saved)
    features = [saved[0], sum(saved[:3]) / len(saved[:3]), sum(saved) / n, *(over(k) / n for k in (1, 2, 3, 4, 6)), *(math.log1p(over(k)) for k in (2, 3, 4)), math.log1p(n)]
    if not model.means:
        return 1 / (1 + math.exp(-model.weights[0]))
    z = model.weights[0] + sum(w * (f - m) / s for w, f, m, s in zip(model.weights[1:], features, model.means, model.scales, strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def documents(spark, folder, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", *columns).collect()]


@pytest.mark.parametrize("name", ["small", "repeated"])
def test_toxicity_scores(spark, request, name):
    folder = request.getfixturevalue(name)
    docs = documents(spark, folder)
    model = toxicity_model(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))
    found = Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in QUERIES["op4_toxicity_dictionaries"](spark, folder).collect())
    wanted = Counter()
    for i, text in docs:
        score = plain_score(model, text)
        wanted[i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(score, 9), int(score >= 0.7)] += 1
    assert found == wanted


def test_mined_verdicts(spark, medium, monkeypatch):
    """All mined rules against all pages that the list doesn't judge, one by one."""
    mined = []
    plain = url_filter.matched_labels
    monkeypatch.setattr(url_filter, "matched_labels", lambda sets, rules: mined.append(rules.collect()) or plain(sets, rules))
    odd = [(900_000 + i, u) for i, u in enumerate(["http://x.example.com/de/1", "https://a.net/es/5?page=2", "http://b.example.net/fr/7.html", "ftp://c.dev/", None, "http://d.example.com"])]
    pages = spark.read.parquet(f"{medium}/pages.parquet").select("page_id", "url").union(spark.createDataFrame(odd, "page_id long, url string"))
    verdicts = {r.page_id: r.verdict for r in url_filter.judge_urls(pages).collect()}
    host, path = url_filter.url_parts(F.col("url"))
    told = pages.withColumns({"host": host, "path": path})
    rows = told.select("page_id", "url", url_filter.url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).collect()
    assert mined and mined[0]
    n = 0
    for r in rows:
        listed = brute.url(r.url)[3]
        fits = [m for m in mined[0] if set(m.tokens) <= set(r.tokens)]
        best = max(fits, key=lambda m: (m.confidence, m.support, m.label, m.tokens), default=None)
        assert verdicts[r.page_id] == (listed or (best.label if best else url_filter.DEFAULT))
        n += listed is None and best is not None
    assert n > 20


def test_repeated_rows_are_packed_each(spark, repeated):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    sizes = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    rows = QUERIES["op3_best_fit_packing"](spark, repeated).collect()
    starts = Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert starts == Counter((i, sizes(t)) for i, t in documents(spark, repeated))
    assert sum(r.length for r in rows) == sum(sizes(t) for _, t in documents(spark, repeated))
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_repeated_rows_are_mixed_each(spark, repeated):
    docs = documents(spark, repeated, "source")
    size = lambda t: len(brute.WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    wanted = brute.targets(dict(sizes))
    rows = QUERIES["op6_flow_mixing"](spark, repeated).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 3)) for r in rows) == Counter((i, size(t), sizes[s], round(wanted[s], 3)) for i, t, s in docs)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[round(r.target, 3), r.source_size] += r.taken
    for s in sizes:
        same = [x for x in sizes if (round(wanted[x], 3), sizes[x]) == (round(wanted[s], 3), sizes[s])]
        longest = max(size(t) for _, t, x in docs if x in same)
        assert abs(taken[round(wanted[s], 3), sizes[s]] - sum(wanted[x] for x in same)) <= len(same) * (longest + 1)


def test_repeated_urls(spark, repeated):
    rows = QUERIES["op7_url_rules"](spark, repeated).collect()
    pages = spark.read.parquet(f"{repeated}/pages.parquet").select("page_id", "url").collect()
    wanted = Counter((r.page_id, *brute.url(r.url)[:3]) for r in pages)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == wanted


def test_repeated_fingerprints(spark, repeated):
    """A component is the smallest id that links reach, whatever rows share a fingerprint; null ids are no name."""
    docs = documents(spark, repeated)
    prints = [brute.fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(docs, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    wanted = Counter((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(docs, prints, group, strict=True))
    found = Counter((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_pivots"](spark, repeated).collect())
    assert found == wanted


def test_repeated_recordings(spark, repeated):
    """Equal vectors are one class, with a null id or without; vectors of nulls are classes of their own."""
    rows = QUERIES["op8_chroma_alignment"](spark, repeated).collect()
    vectors = spark.read.parquet(f"{repeated}/embeddings.parquet").select("vec_id").collect()
    assert Counter(r.vec_id for r in rows) == Counter(r.vec_id for r in vectors)
    classes = {r.class_id for r in rows if r.vec_id in (1, None)}
    assert len(classes) == 1


def test_vectors_with_clashing_names(spark, small, tmp_path):
    """Other columns, whatever their names, change nothing."""
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").limit(60)
    extra = {"rid": F.lit(1), "frames": F.lit("x"), "token": F.lit(2), "node": F.lit(3), "a": F.lit(4), "class_id": F.lit("c"), "row": F.lit(5)}
    vectors.coalesce(1).write.parquet(f"{tmp_path}/plain/embeddings.parquet")
    vectors.withColumns(extra).coalesce(1).write.parquet(f"{tmp_path}/more/embeddings.parquet")
    found = [sorted(map(tuple, QUERIES["op8_chroma_alignment"](spark, f"{tmp_path}/{x}").collect()), key=str) for x in ("plain", "more")]
    assert found[0] == found[1] and found[0]


def test_labels_with_clashing_names(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    more = labels.withColumns({"text": F.lit("x"), "id": F.lit(1), "label": F.lit(0), "order": F.lit(2), "score": F.lit(0.5), "hash": F.lit(3)})
    assert toxicity.train(docs, more) == toxicity.train(docs, labels)
