"""Streams against their batch forms."""

from datetime import datetime, timedelta

import pytest

from tidewell.operators.engagement import exposure_islands
from tidewell.streaming import exposure


def drain(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_distinct_impressions(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(minutes=i % 7), f"k{i % 5}") for i in range(40)]
    spark.createDataFrame(rows, "ts timestamp, impression_key string").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, impression_key string").parquet(str(tmp_path / "e"))
    assert sorted(r.impression_key for r in drain(spark, exposure.distinct_impressions(s), "imps").collect()) == [f"k{i}" for i in range(5)]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    yield spark
    spark.conf.unset(key)


class Samples:
    """Batches of samples, one file each, for a stream that is stopped and started again from its checkpoint between them."""

    KIND = "item_id long, at timestamp, ratio double, visible boolean"

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        (path / "in").mkdir()

    def put(self, *rows):
        t = datetime(2024, 1, 1)
        self.n += 1
        df = self.spark.createDataFrame([(i, t + timedelta(milliseconds=ms), ratio, seen) for i, ms, ratio, seen in rows], self.KIND)
        df.coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        s = self.spark.readStream.schema(self.KIND).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))
        q = exposure.seen_items(s).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        base = 1704067200000
        return sorted((r.item_id, r.seen_at - base) for r in self.spark.read.schema("item_id long, seen_at long").parquet(str(self.path / "out")).collect())


CLOCK = 99  # an item that is never shown; its samples move time on


def test_exposure_needs_half_a_second_and_no_further_sample(rocksdb, tmp_path):
    s = Samples(rocksdb, tmp_path)
    assert s.put((1, 0, 0.49, True), (1, 1000, 0.5, True), (CLOCK, 1499, 0.0, True)) == []
    assert s.put((CLOCK, 1500, 0.0, True), (CLOCK, 1501, 0.0, True)) == [(1, 1500)]
    # told once, whatever comes later; the stream has been started again from its checkpoint
    assert s.put((1, 2000, 0.0, True), (1, 2100, 1.0, True), (CLOCK, 9000, 0.0, True)) == [(1, 1500)]


def test_exposure_is_cancelled_by_a_drop_and_by_a_hidden_document(rocksdb, tmp_path):
    s = Samples(rocksdb, tmp_path)
    assert s.put((1, 0, 0.8, True), (1, 300, 0.2, True), (CLOCK, 800, 0.0, True)) == []
    assert s.put((1, 800, 0.8, True), (1, 1100, 0.8, False), (CLOCK, 1700, 0.0, True)) == []
    # a sample behind the watermark changes nothing
    assert s.put((1, 900, 0.9, True), (1, 1750, 0.8, True), (CLOCK, 2000, 0.0, True)) == []
    assert s.put((CLOCK, 3000, 0.0, True)) == [(1, 2250)]


def test_exposures_of_a_stream_are_those_of_the_batch(rocksdb, tmp_path):
    rows = [(i % 4, at, 0.9 if (at // 400 + i) % 3 else 0.2, True) for i in range(4) for at in range(0, 4000, 100)]
    df = rocksdb.createDataFrame(rows, "item_id long, at_ms long, ratio double, visible boolean")
    got = Samples(rocksdb, tmp_path).put(*rows, (CLOCK, 9000, 0.0, True))
    assert set(got) >= {(r.item_id, r.seen_at) for r in exposure_islands(df).select("item_id", "seen_at").collect()} and {i for i, _ in got} == {0, 1, 2, 3}
