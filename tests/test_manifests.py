"""Tables with manifests: one of many writers wins, and a reader never finds a table missing."""

import threading

import pytest
from pyspark.sql import functions as F

from sparkreef.sources import manifests


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        manifests.read(spark, path)
    assert manifests.replace(spark.range(5), path).number == 1
    assert manifests.replace_if_changed(spark.range(5).repartition(3), path) is None
    second = manifests.replace_if_changed(spark.range(4), path, )
    assert second.number == 2 and manifests.read(spark, path).count() == 4 and manifests.read(spark, path, 1).count() == 5
    with pytest.raises(manifests.Taken):
        manifests.replace(spark.range(9), path, expected=1)
    assert manifests.read(spark, path).count() == 4
    assert manifests.tidy(spark, path, 1) == 1
    assert manifests.numbers(spark, path) == [2] and manifests.read(spark, path).count() == 4


def test_one_of_many_writers_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    manifests.replace(spark.range(1), path)
    won, lost = [], []

    def write(n):
        try:
            won.append((n, manifests.replace(spark.range(n), path, expected=1)))
        except manifests.Taken:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(10, 16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 5
    assert manifests.read(spark, path).count() == won[0][0]
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]
    assert len(folders) == 2  # losers have removed what they wrote


def test_many_creators_of_one_name(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((manifests.create_once(spark, str(tmp_path / "x"), str(i)), str(i)))) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for ok, i in won if ok]
    assert len(winners) == 1 and (tmp_path / "x").read_text() == winners[0]
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["x"]


def test_readers_find_a_version_at_all_times(spark, tmp_path):
    path = str(tmp_path / "t")
    manifests.replace(spark.range(1), path)
    found, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            found.append(manifests.read(spark, path).count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 6):
        manifests.replace(spark.range(n), path)
    stop.set()
    reader.join()
    assert found == sorted(found) and set(found) <= {1, 2, 3, 4, 5}


def test_promotion(spark, tmp_path):
    path = str(tmp_path / "t")
    none_null = lambda df: df.where(F.col("id").isNull())
    assert manifests.promote(spark.range(5), path, none_null) == ("registered", None)
    state, wrong = manifests.promote(spark.createDataFrame([(None,), (1,)], "id long"), path, none_null)
    assert state == "refused" and wrong.count() == 1 and manifests.read(spark, path).count() == 5
    assert manifests.promote(spark.range(7), path, none_null)[0] == "registered"
    assert manifests.read(spark, path).count() == 7 and manifests.version(spark, path).entry["verified"]
