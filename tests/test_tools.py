import pytest
from pyspark.sql import functions as F

from sightline.operators import metrics, profile, prompts, sampling
from sightline.plans.tools import TOOLS
from sightline.sources import charts, scenarios


def test_scenarios_end_to_end(spark):
    parts = scenarios.segments(spark)
    truth = scenarios.expected_events(parts)
    rows = profile.normalised(scenarios.motion(parts))
    cuts = profile.scene_cuts(rows)
    marked = rows.join(cuts.withColumn("is_scene_cut", F.lit(True)), ["video_id", "idx"], "left").withColumn("is_scene_cut", F.coalesce("is_scene_cut", F.lit(False)))
    chosen = sampling.chosen_frames(marked, 16, 0.25).join(rows.select("video_id", "idx", "t_ms"), ["video_id", "idx"])
    got = metrics.corpus_metrics(metrics.video_metrics(truth, chosen, 1000)).first()
    assert got.recall == 1.0 and got.mean_offset < 300
    assert chosen.groupBy("video_id").count().agg(F.max("count")).first()[0] <= 16
    assert metrics.false_cuts(cuts.join(rows, ["video_id", "idx"]), truth, 1000).count() == 0


def test_tools(spark):
    rows = profile.normalised(scenarios.motion(scenarios.segments(spark))).withColumn("is_scene_cut", F.lit(False))
    assert len(TOOLS) == 7
    assert TOOLS["motion_profile"](rows.drop("score", "is_scene_cut")).filter("video_id = 0").count() == 20
    ranges = spark.createDataFrame([(2, 1, 12_000, 15_000), (2, 2, 0, 3_000)], "video_id long, range_id long, a long, b long")
    zoomed = TOOLS["zoom_range"](rows, ranges, 4).collect()
    assert {x.range_id for x in zoomed} == {1, 2} and len(zoomed) <= 8 and all(x.idx >= 180 for x in zoomed if x.range_id == 1)
    near = TOOLS["get_frame"](rows, spark.createDataFrame([(0, 40)], "video_id long, t_ms long")).first()
    assert near.frame_ms == 67
    clip = TOOLS["clip_range"](spark.createDataFrame([(1, 0, 4000), (1, 5, 5)], "video_id long, t0 long, t1 long")).collect()
    assert [(c.time_scale, c.service_frames, c.effective_fps) for c in clip] == [(4.0, 32, 8.0)]
    crop = TOOLS["crop_region"](spark.createDataFrame([(1, 0, 100, 50)], "video_id long, idx long, width int, height int"), 0.5, -1, 0.9, 0.5).first()
    assert (crop.left, crop.top, crop.right, crop.bottom) == (50, 0, 100, 25)
    assert TOOLS["sample_overview"](rows).filter("video_id = 4").count() > 8
    info = spark.createDataFrame([(1, 5, 25.0, 3, 4, "x", 9)], "video_id long, duration_ms long, fps double, width int, height int, codec string, size_bytes long")
    assert len(TOOLS["video_info"](info).columns) == 6


def test_prompts(spark):
    fragments = spark.createDataFrame([("v", "intro", True, "Hello {name}."), ("v", "more", False, " See {sound} {gone}"), ("v", "end", True, "Bye.")], "agent string, fragment string, editable boolean, text string")
    overrides = spark.createDataFrame([("v", "end", "So long."), ("v", "more", "no")], "agent string, fragment string, text string")
    kinds = spark.createDataFrame([("k", "v", "intro", 1, "prefix", None), ("k", "v", "more", 2, "prefix", "sound"), ("k", "v", "end", 1, "suffix", None)], "kind string, agent string, fragment string, pos int, part string, needs string")
    contexts = spark.createDataFrame([(1, "k", {"name": "A", "sound": "--- x"}), (2, "k", {"name": "B"})], "context_id long, kind string, values map<string,string>")
    got = {x.context_id: x for x in prompts.rendered(kinds, prompts.resolved(fragments, overrides), contexts).collect()}
    assert got[1].prefix == "Hello A. See [?] - - - x {gone}" and got[1].suffix == "So long." and got[1].missing == ["gone"]
    assert got[2].prefix == "Hello B." and got[2].missing == [] and len(got[2].digest) == 16


def test_charts(spark):
    rows = profile.bucketed(profile.normalised(scenarios.motion(scenarios.segments(spark))).filter("video_id = 1").withColumn("is_scene_cut", F.col("idx") == 120), 1000)
    drawn = charts.svg(rows)
    assert drawn.count('class="cut"') == 1 and drawn.startswith("<svg") and ">2s<" in drawn
    assert charts.tick(10_000) == 1_000 and charts.tick(10_010) == 2_000 and charts.tick(10**12) == charts.TICKS_MS[-1]
    assert charts.markdown(spark.range(2)) == "|id|\n|-|\n|0|\n|1|"
    with pytest.raises(ValueError):
        charts.markdown(spark.range(300))
