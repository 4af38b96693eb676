"""Rates, batch scores, sound in pieces, headers, requests and measured streams."""

import io
import json
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import sound
from sightline.operators import rates, scoring
from sightline.sources import headers
from sightline.streaming import jobs
from sightline.streaming.commits import Commits
from sightline.streaming.measured import Measured, measured
from sightline.streaming.requests import REPLIES, answered, reply_sink, routed


def test_rates_of_counters(spark):
    # a sample each 15 s from 0 to 60, a reset after 30 s, and another series with a single sample
    rows = [("a", float(t), v) for t, v in ((0, 100.0), (15, 130.0), (30, 160.0), (45, 20.0), (60, 50.0))] + [("b", 30.0, 5.0)]
    df = spark.createDataFrame(rows, "job string, t double, value double")
    got = {(r.job, r.at): r.rate for r in rates.rates(df, ["job"], 60, 60).collect()}
    # within (0, 60]: 30 + 20 + 30 between 15 s and 60 s, carried on by 15 s to the window's start
    assert set(got) == {("a", 60.0)} and math.isclose(got["a", 60.0], 80 * (45 + 15) / 45 / 60)
    got = {r.at: r.rate for r in rates.rates(df.filter("job = 'a'"), ["job"], 30, 15).collect()}
    assert set(got) == {15.0, 30.0, 45.0, 60.0} and math.isclose(got[30.0], 30 * (15 + 15) / 15 / 30)
    # a young counter is not carried on to before it was 0
    young = spark.createDataFrame([("a", 50.0, 0.0), ("a", 60.0, 10.0)], "job string, t double, value double")
    assert math.isclose(rates.rates(young, ["job"], 60, 60).first().rate, 10 / 60)
    assert rates.rates(df.limit(0), ["job"], 60, 60).collect() == []


def test_shares_sums_and_quantiles(spark):
    found = spark.createDataFrame([("a", "200", 60.0, 3.0), ("a", "503", 60.0, 1.0), ("b", "200", 60.0, 0.0)], "job string, status string, at double, rate double")
    got = {r.job: (r.rate, r.percent) for r in rates.error_share(found, ["job"], F.col("status").rlike("5..")).collect()}
    assert got == {"a": (4.0, 25.0), "b": (0.0, None)}
    gauges = spark.createDataFrame([("x", "a", 10.0, 4.0), ("x", "a", 50.0, 6.0), ("y", "a", 55.0, 1.0), ("z", "b", 5.0, 9.0)], "series string, job string, t double, value double")
    assert {(r.job, r.at): r.value for r in rates.gauge_sums(gauges, ["series", "job"], ["job"], 60, 30).collect()} == {("a", 60.0): 7.0}
    inf = float("inf")
    buckets = [("a", 0.1, 10.0), ("a", 0.5, 30.0), ("a", 1.0, 40.0), ("a", inf, 40.0), ("top", 1.0, 1.0), ("top", inf, 100.0), ("bare", 1.0, 5.0), ("none", 1.0, 0.0), ("none", inf, 0.0), ("low", -1.0, 9.0), ("low", inf, 9.0), ("one", inf, 3.0)]
    df = spark.createDataFrame(buckets, "job string, le double, count double")
    got = {r.job: r.value for r in rates.histogram_quantile(df, ["job"], 0.95).collect()}
    assert math.isclose(got.pop("a"), 0.5 + 0.5 * (38 - 30) / 10) and got == {"top": 1.0, "bare": None, "none": None, "low": -1.0, "one": None}


def test_batches_are_halved_until_they_fit(spark):
    r = np.random.default_rng(0)
    windows = [(k % 3, k, 2, r.random(2 * (3 + k % 5)).tolist()) for k in range(40)] + [(9, 0, 2, []), (9, 1, 2, None)]
    df = spark.createDataFrame(windows, "video_id long, w long, bands int, features array<float>").coalesce(1)

    def load(most):
        def model(x):
            if len(x) > most:
                raise RuntimeError("CUDA error: out of memory")
            return np.stack([x.sum(axis=(1, 2)), x.max(axis=(1, 2))], axis=1)

        return lambda: model

    told = lambda most: sorted(tuple(x) for x in scoring.window_scores(df, load(most), 16).collect())
    whole = told(1000)
    assert len(whole) == 80
    for most in (3, 1):  # padding changes how sums are rounded
        got = told(most)
        assert [x[:3] for x in got] == [x[:3] for x in whole] and np.allclose([x[3] for x in got], [x[3] for x in whole], rtol=1e-5)
    calls = []

    def counting(x):
        calls.append(len(x))
        return load(3)()(x)

    out, used = scoring.scored(counting, [np.ones((2, 4), np.float32)] * 10, 16)
    assert used == 2 and calls == [10, 8, 4, 2, 2, 2, 2, 2] and out.shape == (10, 2)
    with pytest.raises(RuntimeError):
        scoring.scored(load(0)(), [np.ones((2, 4))], 4)
    with pytest.raises(KeyError):
        scoring.scored(lambda x: {}["no memory mark"], [np.ones((2, 4))], 4)
    with pytest.raises(ValueError):
        scoring.scored(load(9)(), [np.ones((2, 1013))], 4)


@pytest.mark.parametrize("source, target", [(44100, 16000), (8000, 16000), (16000, 16000), (48000, 16000)])
def test_pieces_and_the_whole_sound_alike(spark, source, target):
    r = np.random.default_rng(1)
    whole = r.standard_normal(2 * 9001).astype(np.float32)
    cuts = [0, 2000, 2600, 7000, 9001]
    rows = [(1, k, source, 2, whole[2 * a : 2 * b].tolist()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(2, 0, source, 2, whole.tolist()), (3, 0, source, 2, None)]
    df = spark.createDataFrame(rows, "video_id long, seq int, rate int, channels int, samples array<float>").repartition(3)
    got = {}
    for x in sorted(sound.resampled(df, target).collect(), key=lambda x: (x.video_id, x.seq)):
        assert x.start == len(got.setdefault(x.video_id, []))
        got[x.video_id] += x.samples
    assert got[1] == got[2] and len(got[1]) == 9001 * target // source and got[3] == []
    mono = sound.downmixed(whole, 2)
    if source == target:
        assert np.allclose(got[1], mono, atol=1e-6)


def test_a_tone_stays_a_tone():
    t = np.arange(44100) / 44100
    out = sound.resampled_part(np.sin(2 * np.pi * 440 * t), 0, 44100, 44100, 16000, 0, 16000)
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(out[200:-200] - want[200:-200]).max() < 2e-3
    # what the new rate can't hold is taken out
    high = sound.resampled_part(np.sin(2 * np.pi * 12000 * t), 0, 44100, 44100, 16000, 0, 16000)
    assert np.abs(high[200:-200]).max() < 0.02


def test_sound_that_cant_be_mixed(spark):
    with pytest.raises(ValueError):
        sound.downmixed([1.0] * 6, 3)
    with pytest.raises(ValueError):
        sound.downmixed([1.0] * 5, 2)
    assert sound.downmixed([1.0, 1.0], 2).tolist() == [pytest.approx(math.sqrt(2))]
    schema = "video_id long, seq int, rate int, channels int, samples array<float>"
    for rows in ([(1, 0, 8000, 6, [0.0] * 6)], [(1, 0, 8000, 1, [0.0] * 5), (1, 1, 8000, 1, [0.0] * 500)], [(1, 0, 8000, 1, [0.0] * 500), (1, 1, 16000, 1, [0.0] * 500)]):
        with pytest.raises(Exception, match="ValueError"):
            sound.resampled(spark.createDataFrame(rows, schema), 16000).collect()


def box(kind, *content, wide=False):
    body = b"".join(content)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def track(scale, length, *frames):
    head = struct.pack(">IIIIII", 0, 0, 0, scale, length, 0)
    table = struct.pack(">II", 0, len(frames)) + b"".join(struct.pack(">II", *f) for f in frames)
    return box(b"trak", box(b"mdia", box(b"mdhd", head), box(b"minf", box(b"stbl", box(b"stts", table)))))


class Watched(io.BytesIO):
    def __init__(self, data, forbidden):
        super().__init__(data)
        self.forbidden = forbidden

    def read(self, n=-1):
        at = self.tell()
        out = super().read(n)
        assert not (at < self.forbidden[1] and at + len(out) > self.forbidden[0]), "media data was read"
        return out


def test_durations_from_headers(spark, tmp_path):
    media = box(b"mdat", bytes(100_000), wide=True)
    front = box(b"ftyp", b"isom0000")
    movie = front + media + box(b"moov", box(b"mvhd", bytes(100)), track(1000, 5000, (100, 40)), track(600, 0, (30, 300)), track(1000, 0xFFFFFFFF))
    assert headers.seconds(Watched(movie, (len(front) + 16, len(front) + len(media))), len(movie)) == 15.0
    empty = front + box(b"moov", track(1000, 0))
    assert headers.seconds(io.BytesIO(empty), len(empty)) is None
    for broken in (b"", b"RIFF", b"\x00\x00", movie[:40], movie[:-30], b"RIFF\x00\x00\x00\x00WAVEfmt "):
        headers.seconds(io.BytesIO(broken), len(broken))
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(4 * 12_000))
    (tmp_path / "b.mp4").write_bytes(movie)
    (tmp_path / "c.txt").write_text("no recording")
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.wav", "b.mp4", "c.txt", "gone.wav")], "path string")
    assert {r.path.rsplit("/", 1)[1]: r.duration_s for r in headers.durations(spark, paths).collect()} == {"a.wav": 1.5, "b.mp4": 15.0, "c.txt": None, "gone.wav": None}


def test_requests_are_answered_one_by_one(spark, tmp_path):
    def zoom(x):
        if x["t1"] <= x["t0"]:
            raise ValueError("empty range")
        return {"video_id": x["video_id"], "ms": x["t1"] - x["t0"]}

    handlers = {"zoom": zoom, "broken": lambda x: 1 / 0}
    catalog = spark.createDataFrame([("zoom",), ("broken",), ("unserved",)], "name string")
    rows = [("stream.tool.zoom", "r1", '{"video_id": "v", "t0": 1, "t1": 5}'), ("stream.tool.zoom", "r2", '{"video_id": "v", "t0": 5, "t1": 5}'), ("stream.tool.zoom", "r3", "not json"), ("stream.tool.nope", "r4", "{}"), ("stream.tool.broken", "r5", "{}"), ("stream.tool.unserved", "r6", "{}"), ("stream.tool.zoom", None, "{}"), ("other", "r7", "{}"), ("stream.tool.zoom", "r8", None), ("stream.tool.zoom", "r1", '{"video_id": "v", "t0": 1, "t1": 5}')]
    messages = spark.createDataFrame(rows, "subject string, reply string, payload string")
    got = {r.reply: (r.code, json.loads(r.body)) for r in answered(routed(messages, catalog), handlers).collect()}
    assert {k: v[0] for k, v in got.items()} == {"r1": "ok", "r2": "bad_request", "r3": "bad_request", "r4": "unknown_tool", "r5": "internal", "r6": "unknown_tool", "r8": "bad_request"}
    assert got["r1"][1] == {"video_id": "v", "ms": 4} and got["r2"][1]["message"] == "empty range"
    log = Commits(spark, str(tmp_path / "t"))
    sink = reply_sink(log, "tools", catalog, handlers)
    sink(messages, 0)
    sink(messages, 0)
    assert log.read("replies", REPLIES).count() == 7
    assert [(r.channel, r.video_id) for r in log.read("messages", "channel string, video_id string").collect()] == [("alerts", "v")]


def test_streams_are_measured(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "n int").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(4,), (5,)], "n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = Measured(spark, str(tmp_path / "told"))
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("n"), F.max("n").alias("most"))
        query = rows.writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(100):
            if measured(spark, str(tmp_path / "told")).filter("name = 'counted' and rows > 0").count() == 2:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = measured(spark, str(tmp_path / "told")).filter("name = 'counted' and rows > 0").collect()
    assert sorted(r.rows for r in got) == [2, 3] and {r.observed["seen.most"] for r in got} == {"3", "5"} and all(r.took_ms > 0 for r in got)


def test_an_empty_first_batch_begins_the_table(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k string, version long"
    sink = jobs.upsert_sink(path, ["k"], ["version"])
    sink(spark.createDataFrame([], schema), 0)
    assert jobs.latest_rows(spark, path).collect() == []
    sink(spark.createDataFrame([], schema), 1)
    sink(spark.createDataFrame([("a", 1)], schema), 2)
    assert [tuple(x) for x in jobs.latest_rows(spark, path).collect()] == [("a", 1)]
