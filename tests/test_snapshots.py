"""The compacted sink against a plain dictionary: many batches, replays, crashes, awkward rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fringeframe.streaming import acquisition as J
from fringeframe.streaming import snapshots
from fringeframe.streaming.snapshots import keyed_sink, snapshot

SCHEMA = "k string, n bigint, o bigint"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return sum(1 for p in Path(path).rglob("*") if p.is_file())


def test_fifty_batches_keep_the_newest_row_in_few_files(spark, tmp_path):
    path, rng, want, counts = str(tmp_path / "t"), random.Random(1), {}, []
    sink = keyed_sink(path, "k", buckets=4)
    for batch in range(50):
        # One key comes with every batch, one is null, and some batches are empty.
        keys = [] if batch % 9 == 5 else ["hot", None, *(f"k{rng.randrange(60)}" for _ in range(5))]
        new = [(k, batch, i) for i, k in enumerate(keys)]
        sink(spark.createDataFrame(new, SCHEMA), batch)
        for r in new:
            want[r[0]] = r
        counts.append(files(path))
        if batch % 10 == 9:
            assert rows(snapshot(spark, path)) == sorted(want.values(), key=str)
    assert max(counts[40:]) <= max(counts[5:15]) + 8 and max(counts) < 60


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = keyed_sink(path, "k")
    sink(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA), 0)
    sink(spark.createDataFrame([("a", 2, 1)], SCHEMA), 1)
    before, names = rows(snapshot(spark, path)), sorted(Path(path).rglob("*"))
    assert before == [("a", 2, 1), ("b", 1, 1)]
    sink(spark.createDataFrame([("a", 2, 1)], SCHEMA), 1)
    sink(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA), 0)
    assert rows(snapshot(spark, path)) == before and sorted(Path(path).rglob("*")) == names
    # Another query's numbers are its own.
    keyed_sink(path, "k", stream="later")(spark.createDataFrame([("c", 3, 1)], SCHEMA), 0)
    assert rows(snapshot(spark, path)) == [*before, ("c", 3, 1)]


def test_a_batch_that_fails_before_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sink = keyed_sink(path, "k", buckets=2)
    sink(spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], SCHEMA), 0)
    before = rows(snapshot(spark, path))

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", fails)
        with pytest.raises(OSError):
            sink(spark.createDataFrame([("a", 2, 1), ("d", 2, 1)], SCHEMA), 1)
    assert rows(snapshot(spark, path)) == before
    sink(spark.createDataFrame([("a", 2, 1)], SCHEMA), 1)
    assert rows(snapshot(spark, path)) == [("a", 2, 1), ("b", 1, 1), ("c", 1, 1)]


def test_edge_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        snapshot(spark, path)
    sink = keyed_sink(path, "k")
    sink(spark.createDataFrame([], SCHEMA), 0)
    assert snapshot(spark, path).count() == 0 and snapshot(spark, path).columns == ["k", "n", "o"]
    sink(spark.createDataFrame([("a", None, None), ("a", 1, 5), ("a", 1, 7)], SCHEMA), 1)
    assert rows(snapshot(spark, path)) == [("a", 1, 7)]
    keys = str(tmp_path / "keys")
    keyed_sink(keys, "k")(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), 0)
    assert rows(snapshot(spark, keys)) == [("a",), (None,)]
    with pytest.raises(ValueError):
        sink(spark.createDataFrame([("a", 1)], "k string, snapshot_bucket int"), 2)


def test_running_counts_of_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for part in range(5):
        spark.range(part * 40, part * 40 + 40).select((F.col("id") % 7).alias("k"), "id").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k bigint, id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    seen = []
    sink = keyed_sink(path, "k", buckets=3)

    def counted(batch, number):
        sink(batch, number)
        seen.append(files(path))

    J.run_available(stream.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total")), counted, "update")
    want = spark.read.parquet(source).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    assert rows(snapshot(spark, path)) == rows(want) and len(seen) >= 5
