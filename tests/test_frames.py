"""Made-up recordings and raw frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions.media import frame_features
from sightline.operators import metrics, profile, sampling
from sightline.sources import rasters, scenarios
from sightline.sources.grey_frames import grey_at, grey_frames, layout


def test_ten_recordings_from_frames_to_metrics(spark):
    """As published of the engine that this one stands beside: 24 of 24 events, 35 ms mean offset, 15.3 frames, 78-fold
    reduction, 1 false cut, no gap violation, on pictures drawn by a tool that is not here."""
    parts = rasters.segments(spark)
    rows = profile.normalised(frame_features(rasters.frames(parts))).persist()
    cuts = profile.scene_cuts(rows).withColumn("is_scene_cut", F.lit(True))
    rows_with_cuts = rows.join(cuts, ["video_id", "idx"], "left").withColumn("is_scene_cut", F.coalesce("is_scene_cut", F.lit(False)))
    truth = scenarios.expected_events(parts)
    videos = parts.groupBy("video_id").agg(F.round(F.sum("seconds") * 1000).cast("long").alias("duration_ms"), F.round(F.sum("seconds") * 30).cast("long").alias("source_frames"))
    got = metrics.selection_metrics(truth, rows_with_cuts, videos, sampling.Sampling(), 1000).toPandas()
    rows.unpersist()
    assert len(got) == 10 and got.events_total.sum() == 24 and got.events_covered.sum() == 24 and got.worst_miss_ms.isna().all()
    assert got[got.events_total > 0].mean_offset_ms.mean() < 60 and got.selected_frames.mean() <= 16 and got.reduction_ratio.mean() > 70
    assert got.false_scene_cuts.sum() <= 1 and not got.gap_violated.any()
    assert got.set_index("video_id").recall[3] != got.set_index("video_id").recall[3]  # no events, no recall


def test_frames_are_drawn_alike_by_every_task(spark):
    few = (rasters.Recording("a", (("still", 0.5), ("object 100", 0.5)), 20), rasters.Recording("b", (("moving", 1.0), ("still", 0.0)), 0))
    once = rasters.frames(rasters.segments(spark, few), 32, 18, 10.0)
    again = rasters.frames(rasters.segments(spark, few).repartition(7), 32, 18, 10.0)
    rows = {(r.video_id, r.idx): bytes(r.data) for r in once.collect()}
    assert rows == {(r.video_id, r.idx): bytes(r.data) for r in again.collect()} and len(rows) == 20
    assert rows[0, 0] != rows[0, 1] and rows[1, 0] != rows[1, 1]
    with pytest.raises(Exception, match="no such scene"):
        rasters.frames(rasters.segments(spark, (rasters.Recording("c", (("what", 1.0),)),))).collect()


def y4m(path, frames, rate="10:1", colour="420jpeg", cut=0):
    n, h, w = frames.shape
    rest = {"mono": 0, "420jpeg": 2 * -(-h // 2) * -(-w // 2), "444": 2 * h * w}[colour]
    data = b"".join(b"FRAME\n" + f.tobytes() + bytes(rest) for f in frames)
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 C{colour}\n".encode() + (data[:-cut] if cut else data))


def test_raw_frames(spark, tmp_path):
    r = np.random.default_rng(0)
    a, b = r.integers(0, 256, (25, 5, 7), np.uint8), r.integers(0, 256, (3, 4, 6), np.uint8)
    folder = tmp_path / "in"
    folder.mkdir()
    y4m(folder / "a.y4m", a)
    y4m(folder / "b.y4m", b, "30000:1001", "mono")
    (folder / "c.pgm").write_bytes(b"".join(b"P5\n6 4\n255\n" + f.tobytes() for f in b))
    (folder / "notes.txt").write_text("no frames")
    rows = grey_frames(spark, str(folder), range_bytes=200, fps=4)
    assert rows.rdd.getNumPartitions() > 8
    got = {(x.path.rsplit("/", 1)[1], x.idx): x for x in rows.collect()}
    assert len(got) == 31
    for name, want, ms in (("a.y4m", a, [100 * i for i in range(25)]), ("b.y4m", b, [0, 33, 67]), ("c.pgm", b, [0, 250, 500])):
        for i, frame in enumerate(want):
            x = got[name, i]
            assert (x.t_ms, x.height, x.width) == (ms[i], *frame.shape) and bytes(x.data) == frame.tobytes()
    # a time is found by its place
    few = grey_frames(spark, str(folder / "a.y4m"), range_bytes=200).filter("t_ms >= 450 and t_ms < 700")
    assert sorted(x.idx for x in few.collect()) == [5, 6] and few.rdd.getNumPartitions() < 4
    one = grey_at(spark, str(folder / "a.y4m"), 401)
    assert one.rdd.getNumPartitions() == 1 and [(x.idx, bytes(x.data)) for x in one.collect()] == [(5, a[5].tobytes())]
    assert grey_at(spark, str(folder / "a.y4m"), 99_999).collect() == []


def test_raw_frames_that_are_broken(spark, tmp_path):
    frames = np.zeros((4, 4, 4), np.uint8)
    y4m(tmp_path / "cut.y4m", frames, cut=3)
    with pytest.raises(Exception, match="ends within frame 3"):
        grey_frames(spark, str(tmp_path / "cut.y4m")).collect()
    assert len(grey_frames(spark, str(tmp_path / "cut.y4m")).filter("t_ms <= 200").collect()) == 3
    y4m(tmp_path / "none.y4m", frames[:0])
    assert grey_frames(spark, str(tmp_path / "none.y4m")).collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        grey_frames(spark, str(tmp_path / "gone.y4m")).collect()
    for head in (b"", b"RIFF", b"YUV4MPEG2 W4 H4 F0:0\n", b"YUV4MPEG2 W4 H4 F1:1 C420p10\n", b"YUV4MPEG2 W4 H4 F1:1\nFRAME Ixyz\n", b"P5\n4 4\n65535\n"):
        with pytest.raises(ValueError):
            layout(head, 15)
