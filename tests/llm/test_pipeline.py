"""Each stage on what its predecessor kept, against plain computation."""

from collections import Counter

import pytest

import brute
import corpus_pipeline
from sparkreef.llm import toxicity
from sparkreef.llm.queries import toxicity_model


@pytest.fixture(scope="module", params=["small", "odd"])
def ran(request, spark, tmp_path_factory):
    sf_dir = request.getfixturevalue(request.param)
    folder = tmp_path_factory.mktemp("stages")
    kept = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], sf_dir).write.parquet(f"{folder}/{name}")
        kept.append(spark.read.parquet(f"{folder}/{name}"))
    return sf_dir, kept


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_columns_stay_until_the_last_stage(ran):
    _, kept = ran
    assert all(df.dtypes == kept[0].dtypes for df in kept[1:-1])


def test_toxic_documents_go(spark, ran):
    sf_dir, (docs, clean, *_) = ran
    scored = toxicity.score_texts(docs, toxicity_model(spark, sf_dir, docs))
    low = {r.doc_id for r in scored.where("score < 0.7").collect()}
    assert rows(clean) == Counter(tuple(r) for r in docs.collect() if r.doc_id in low)


def test_lines_go(ran):
    _, (_, clean, lined, *_) = ran
    wanted = brute.lines([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id: brute.sha(r.text or "") for r in lined.collect()} == {i: w[2] for i, w in wanted.items()}


def test_one_of_each_group_stays(ran):
    _, (_, _, lined, single, *_) = ran
    before, after = {r.doc_id: r.text for r in lined.collect()}, {r.doc_id: r.text for r in single.collect()}
    assert after.items() <= before.items()
    words = lambda t: tuple(w.translate(brute.LOWER) for w in brute.WORD.findall(t or ""))
    runs = lambda w: frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = {i: runs(words(t)) for i, t in before.items()}
    alike = lambda a, b: a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    for i in before.keys() - after.keys():
        assert any(alike(sets[i], sets[j]) for j in before if j != i)
    left = [sets[i] for i in after]
    assert not any(alike(a, b) for n, a in enumerate(left) for b in left[:n])


def test_mix_repeats_within_bounds(ran):
    _, (*_, single, mixed, _) = ran
    one, many = rows(single), rows(mixed)
    assert many.keys() <= one.keys() and all(n <= 2 * one[r] for r, n in many.items())
    size = lambda r: len(brute.WORD.findall(r[1] or ""))
    sizes, taken = Counter(), Counter()
    for r in one:
        sizes[r[3]] += size(r)
    for r, n in many.items():
        taken[r[3]] += n * size(r)
    wanted = brute.targets(dict(sizes))
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= max(size(r) for r in one if r[3] == s) + 1


def test_pieces_cover_the_mix(ran):
    _, (*_, mixed, packed) = ran
    n = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    starts = Counter(r.doc_id for r in packed.where("start = 0").select("doc_id").collect())
    assert n == starts
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_run_is_its_stages(spark, small, ran):
    if ran[0] == small:
        found = corpus_pipeline.run(spark, small)
        assert found.columns == ran[1][-1].columns and found.count() > 0
        folders = {f.split("/corpus-")[1].split("/")[1] for f in found.inputFiles()}
        assert folders == {"4-packing"}
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found.inputFiles()[0]).getParent().getParent()
        left = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
        assert [s.getPath().getName() for s in left] == ["4-packing"]  # the others are gone


def test_empty_documents(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
