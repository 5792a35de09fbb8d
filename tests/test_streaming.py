"""Touches and the store: batch and stream agree, batches that come twice or are cut off change nothing."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from faktum.streaming import store as stores
from faktum.streaming.store import Store
from faktum.streaming.touches import DAY, counted, touch_stream, touches

START = datetime.datetime(2024, 1, 1)


def by_loop(rows, interval):
    out, last = [], {}
    for key, at in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        if key not in last or at - last[key] >= interval:
            last[key] = at
            out.append((key, at))
    return out


def made(n, hours):
    rng = np.random.default_rng(6)
    return [(str(k) if k else None, START + datetime.timedelta(seconds=int(s))) for k, s in zip(rng.integers(0, 4, n), rng.integers(0, hours * 3600, n), strict=True)]


def test_counted():
    assert counted(np.array([0, 1, 9, 10, 11, 20, 31]), None, 10) == [0, 10, 20, 31]
    assert counted(np.array([3, 4]), 0, 4) == [4] and counted(np.array([], np.int64), 5, 1) == []


@pytest.mark.parametrize("batch", [7, 10_000])
def test_batch_equals_a_loop(spark, batch):
    rows = made(600, 400) + [("x", None), ("y", START), ("y", START)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = touches(spark.createDataFrame(rows, "user string, ts timestamp").repartition(5), "user", "ts", DAY).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got), key=str) == sorted(by_loop(rows, datetime.timedelta(days=1)), key=str)


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted((r for r in made(300, 900) if r[0]), key=lambda r: r[1])
    schema = "user string, ts timestamp"
    for k in range(4):
        spark.createDataFrame(rows[k * 75 : (k + 1) * 75], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    names = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
        query = touch_stream(stream, "user", "ts").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        for name in names:
            spark.conf.unset(name)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, touches(spark.createDataFrame(rows, schema), "user", "ts").collect())) and len(got) > 20
    with pytest.raises(ValueError):
        touch_stream(stream, "user", "ts", DAY, 1)


def facts_of(calls):
    def compute(rows):
        calls.append(sorted(r.key for r in rows.select("key").collect()))
        return rows.select("key", F.length("text").alias("n"), (F.col("text") == "short").alias("transient"))

    return compute


def frame(spark, *texts):
    return spark.createDataFrame([(x,) for x in texts], "text string").withColumn("key", F.sha2("text", 256))


def test_the_same_input_computes_once(spark, tmp_path):
    store, calls = Store(spark, str(tmp_path), 3), []
    first = frame(spark, "a", "bb", "bb", "short", None)
    got = store.get_or_compute(first, 0, facts_of(calls))
    assert sorted((r.n for r in got.collect()), key=str) == [1, 2, 5]
    assert sorted(r.n for r in store.facts().collect()) == [1, 2]
    calls.clear()
    store.add(first, 1, facts_of(calls))
    assert len(calls[0]) == 1  # the transient one is computed again, all others are stored
    store.add(frame(spark, "a", "bb"), 2, facts_of(calls))
    assert calls[1] == [] and sorted(r.n for r in store.facts().collect()) == [1, 2]


def test_a_batch_that_was_cut_off_or_comes_twice(spark, tmp_path, monkeypatch):
    store, calls = Store(spark, str(tmp_path), 1), []
    store.add(frame(spark, "one"), 0, facts_of(calls))
    real = Store._path
    monkeypatch.setattr(Store, "_path", lambda self, *parts: 1 / 0 if parts[0] == "ledger" and len(parts) > 1 else real(self, *parts))
    with pytest.raises(ZeroDivisionError):
        store.add(frame(spark, "three", "seven!!"), 1, facts_of(calls))
    monkeypatch.setattr(Store, "_path", real)
    assert store.batches() == [0] and [r.n for r in store.facts().collect()] == [3]
    store.add(frame(spark, "three", "seven!!"), 1, facts_of(calls))
    store.add(frame(spark, "three", "other"), 1, facts_of(calls))  # the number is known, so nothing happens
    assert store.batches() == [0, 1] and sorted(r.n for r in store.facts().collect()) == [3, 5, 7] and len(calls) == 3


def test_bloom_filter_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PLACES", 512)  # so small that it is often wrong
    store = Store(spark, str(tmp_path), 1)
    store.add(frame(spark, *(f"k{i}" for i in range(200))), 0, facts_of([]))
    asked = frame(spark, *(f"k{i}" for i in range(150, 300)))
    assert sorted(r.text for r in store.missing(asked).collect()) == sorted(f"k{i}" for i in range(200, 300))
    bits = store._maybe(store._bloom(store.facts()))
    assert 0 < asked.filter(~bits).count() < 100


def test_earlier_versions_go(spark, tmp_path):
    for version in (1, 2, 4):
        Store(spark, str(tmp_path), version).add(frame(spark, "x"), 0, facts_of([]))
    assert Store(spark, str(tmp_path), 3).facts() is None
    assert Store(spark, str(tmp_path), 3).prune() == [1, 2]
    assert Store(spark, str(tmp_path), 4).facts().count() == 1


def test_a_stream_into_the_store(spark, tmp_path):
    for k, texts in enumerate((["a", "bb"], ["bb", "cccc"])):
        frame(spark, *texts).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    store = Store(spark, f"{tmp_path}/store", 1)
    calls = []
    stream = spark.readStream.schema("text string, key string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stores.run(store, stream, facts_of(calls), f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(300)
    assert sorted(r.n for r in store.facts().collect()) == [1, 2, 4] and sum(map(len, calls)) == 3
