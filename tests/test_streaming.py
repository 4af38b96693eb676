"""Batches through Structured Streaming give what one batch gives."""

import datetime
import json

import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from sightline.operators.islands import hysteresis_runs
from sightline.streaming import jobs


def run(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


@pytest.fixture()
def events(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(v, start + datetime.timedelta(minutes=7 * i + (40 if i > 5 else 0)), float(i)) for v in range(2) for i in range(10)] + [(9, start + datetime.timedelta(days=2), 0.0)]
    df = spark.createDataFrame(rows, "video_id long, ts timestamp, value double").coalesce(1)
    df.write.parquet(str(tmp_path / "events"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))


def test_tumbling_and_sessions(spark, tmp_path, events):
    batch, stream = events
    want = {(x.video_id, x.start, x.n, x.top) for x in jobs.tumbling(batch, "30 minutes").collect() if x.video_id != 9}
    assert {tuple(x) for x in run(jobs.tumbling(stream, "30 minutes"), tmp_path, "tumbling") if x.video_id != 9} == want
    got = run(jobs.sessions(stream, "15 minutes"), tmp_path, "sessions")
    assert sorted((x.video_id, x.n) for x in got if x.video_id != 9) == [(0, 4), (0, 6), (1, 4), (1, 6)]


def test_bad_messages_are_skipped(spark, tmp_path):
    good = json.dumps({"schema_version": 1, "video_id": "v1", "duration_ms": 5})
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text(good + "\nnot json\n{}\n")
    got = run(jobs.decoded(spark.readStream.text(str(tmp_path / "m"))), tmp_path, "decoded")
    assert [(x.video_id, x.duration_ms) for x in got] == [("v1", 5)]


def test_upsert_sink(spark, tmp_path):
    path, rows = str(tmp_path / "table"), lambda x: spark.createDataFrame(x, "k string, version long")
    told = lambda: sorted(map(tuple, jobs.latest_rows(spark, path).collect()))
    with pytest.raises(FileNotFoundError):
        jobs.latest_rows(spark, path)
    sink = jobs.upsert_sink(path, ["k"], ["version"])
    sink(rows([("a", 1), ("b", 1)]), 0)
    sink(rows([("a", 2), ("c", 1), ("a", 3)]), 1)
    assert told() == [("a", 3), ("b", 1), ("c", 1)]
    sink(rows([("a", 2), ("c", 1), ("a", 3)]), 1)
    sink(rows([]), 2)
    assert told() == [("a", 3), ("b", 1), ("c", 1)]
    # a new checkpoint counts its batches from 0 again: the table goes on
    jobs.upsert_sink(path, ["k"], ["version"])(rows([("d", 1), ("b", 9)]), 0)
    assert told() == [("a", 3), ("b", 9), ("c", 1), ("d", 1)]


def test_upsert_sink_raises_where_a_version_is_gone(spark, tmp_path):
    path, rows = str(tmp_path / "table"), lambda x: spark.createDataFrame(x, "k string, version long")
    sink = jobs.upsert_sink(path, ["k"], ["version"])
    with pytest.raises(FileNotFoundError):
        sink(rows([("a", 1)]), 3)
    sink(rows([("a", 1)]), 0)
    (tmp_path / "table" / "v0").rename(tmp_path / "lost")
    with pytest.raises(AnalysisException):
        sink(rows([("a", 2)]), 1)
    with pytest.raises(AnalysisException):
        jobs.latest_rows(spark, path).collect()


def test_change_feed_and_steps(spark, tmp_path):
    snapshot = spark.createDataFrame([("a", 1), ("b", 1)], "video_id string, n int")
    spark.createDataFrame([("a", 2), ("c", 2)], "video_id string, n int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, seen, done = spark.readStream.schema("video_id string, n int").parquet(str(tmp_path / "in")), [], []
    feed = jobs.change_feed(snapshot, "video_id", ["a", "c"], lambda df: seen.extend(map(tuple, df.collect())))
    stream.writeStream.foreachBatch(feed).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == [("a", 1), ("a", 2), ("c", 2)]
    steps = [lambda df: df.selectExpr("video_id", "n + 1 as n"), lambda df: df.selectExpr("video_id", "n * 10 as n")]
    run_all = jobs.per_recording(steps, lambda df: done.extend(map(tuple, df.collect())))
    run_all(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "video_id string, n int"), 0)
    run_all(snapshot.limit(0), 1)
    assert sorted(done) == [("a", 20), ("b", 30)]


def test_values_are_remembered(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    asked = spark.createDataFrame([(1, 0, None), (1, 1, "x"), (1, 2, None), (2, 0, None)], "video_id long, request long, value string")
    asked.coalesce(1).write.parquet(str(tmp_path / "asked"))
    got = run(jobs.remembered(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked")), 3_600_000), tmp_path, "remembered")
    assert sorted((x.video_id, x.request, x.value, x.hit) for x in got) == [(1, 0, None, False), (1, 1, "x", False), (1, 2, "x", True), (2, 0, None, False)]


def test_stateful(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(v, w, s) for v in range(2) for w, s in enumerate([0.0, 0.9, 0.5, 0.8, 0.1, 0.2, 0.95, 0.0])]
    df = spark.createDataFrame(rows, "video_id long, w long, score double")
    df.coalesce(1).write.parquet(str(tmp_path / "scores"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "scores"))
    want = {(x.video_id, x.start_w, x.end_w, round(x.peak, 6)) for x in hysteresis_runs(df, ["video_id"], 0.7, 0.4).collect()}
    assert {(x.video_id, x.start_w, x.end_w, round(x.peak, 6)) for x in run(jobs.hysteresis(stream, 0.7, 0.4), tmp_path, "runs")} == want
    asked = spark.createDataFrame([(1, i, i == 3) for i in range(6)], "video_id long, request long, reset boolean")
    asked.coalesce(1).write.parquet(str(tmp_path / "asked"))
    got = run(jobs.limited(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked")), 2), tmp_path, "limited")
    assert [x.allowed for x in sorted(got, key=lambda x: x.request)] == [True, True, False, True, True, True]


def test_many_keys_of_a_limit(spark, tmp_path):
    """Keys share calls of the state's function, whatever chunks their rows come in; one is null, some are forgotten."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    calls = []

    class Kept(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    class Handle:
        def getMapState(self, *_):
            return calls

    counter, kept = jobs.LimitedCounter(2), Kept()
    counter.init(Handle())
    counter.used = kept
    chunk = lambda r: pd.DataFrame([(False, v, i, False, v % 3 == 0 and i == 5) for i in r for v in range(100)], columns=["none", "video_id", "request", "reset", "forget"])
    out, = counter.handleInputRows((0,), iter([chunk([4, 5]), chunk([0, 3])]), None)
    assert {(v, i): a for v, i, a in out.itertuples(index=False)} == {(v, i): i < 4 or (i == 5 and v % 3 == 0) for v in range(100) for i in (0, 3, 4, 5)}
    assert kept == {(False, v): (4,) for v in range(100) if v % 3}
    asked = spark.createDataFrame([(v, i, i == 3) for v in [None, *range(50)] for i in range(6)], "video_id long, request long, reset boolean")
    asked.write.parquet(str(tmp_path / "asked"))
    got = run(jobs.limited(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked")), 2), tmp_path, "limits")
    assert {(x.video_id, x.request, x.allowed) for x in got} == {(v, i, i != 2) for v in [None, *range(50)] for i in range(6)} and len(got) == 306
