"""Behavioural cases of segmentation, safety rules, sampling and metrics, and folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import folds, islands, joins, metrics, profile, rules, sampling, segments


def scores(spark, *series):
    return spark.createDataFrame([(v, w, float(s)) for v, line in enumerate(series) for w, s in enumerate(line)], "video_id long, w long, score double").withColumn("score", F.col("score").cast("float"))


def segment(spark, line, **more):
    given = dict(threshold=0.5, release=0.3, gap_windows=0, window_sec=2.0, hop_sec=1.0, min_sec=0.0) | more
    rows = segments.segmented(scores(spark, line), ["video_id"], **given).orderBy("start_sec").collect()
    return [(x.start_sec, x.end_sec, round(x.confidence, 3)) for x in rows]


def test_segmentation_cases(spark):
    assert segment(spark, [0, 0.9, 0.4, 0.8, 0]) == [(1.0, 5.0, 0.9)]
    assert len(segment(spark, [0.9, 0.1, 0.9])) == 2
    assert segment(spark, [0.9, 0.1, 0.9], gap_windows=2) == [(0.0, 4.0, 0.9)]
    assert segment(spark, [0.9, 0, 0], min_sec=5.0) == []
    rows = scores(spark, [0, 0.9]).withColumn("d", F.lit(2.5))
    assert segments.segmented(rows, ["video_id"], 0.5, 0.3, 0, 2.0, 1.0, 0.0, "d").first().end_sec == 2.5


def test_runs_equal_the_state_machine(spark):
    r = random.Random(0)
    lines = [[round(r.random(), 2) for _ in range(r.randrange(1, 40))] for _ in range(40)]
    want = []
    for v, line in enumerate(lines):
        start = None
        for w, s in enumerate([*line, -1.0]):
            if start is None and s >= 0.7:
                start = w
            elif start is not None and s < 0.4:
                want.append((v, start, w - 1))
                start = None
    got = islands.hysteresis_runs(scores(spark, *lines).withColumn("score", F.round(F.col("score").cast("double"), 2)), ["video_id"], 0.7, 0.4)
    assert sorted((x.video_id, x.start_w, x.end_w) for x in got.collect()) == want


def events(spark, *rows):
    dim = {"bell": ("alarm", "critical"), "siren": ("alarm", "critical"), "scream": ("distress", "critical"), "truck": ("vehicle", "warning"), "gear": ("machine", "info"), "talk": ("human", "info")}
    data = [(0, i, label, *dim[label], float(a), float(b), 0.5 + i / 100) for i, (label, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "video_id long, pos long, label string, category string, severity string, start double, end double, score double")


@pytest.mark.parametrize(
    "machines,bursts,total,last",
    [([(90, 145)], 1, 45, 145), ([(103, 110), (103, 110), (104, 109)], 1, 7, 110), ([(103, 106), (123, 126)], 2, 6, 126), ([(300, 310)], None, None, None)],
)
def test_post_alarm(spark, machines, bursts, total, last):
    got = rules.post_alarm_activity(events(spark, ("bell", 100, 106), *[("gear", a, b) for a, b in machines]), 120.0).collect()
    assert [(x.bursts, x.total, x.last_end) for x in got] == ([(bursts, total, last)] if bursts else [])


def test_critical_clusters(spark):
    got = rules.critical_clusters(events(spark, ("bell", 10, 20), ("siren", 15, 25), ("scream", 12, 14), ("bell", 25, 30))).orderBy("start").collect()
    assert [(x.category, x.start, x.end, x.best, x.others, x.n) for x in got] == [("alarm", 10, 25, "siren", "bell", 2), ("distress", 12, 14, "scream", "", 1), ("alarm", 25, 30, "bell", "", 1)]
    assert rules.alarm_spans(events(spark, ("bell", 0, 4), ("bell", 8, 9), ("bell", 20, 21))).count() == 2


def test_vehicle_near_person(spark):
    rows = events(spark, ("truck", 0, 100), ("talk", 10, 12), ("scream", 10.5, 13), ("talk", 40, 41), ("talk", 100, 101))
    got = rules.vehicle_near_person(rows, 7.0).orderBy("start").collect()
    assert [(x.start, x.end, x.severity) for x in got] == [(10, 12, "warning"), (40, 41, "warning")]
    strict = rules.vehicle_near_person(rows, 7.0, strict_severity=True).orderBy("start").collect()
    assert [x.severity for x in strict] == ["critical", "warning"]


def test_overlap_join_equals_pairs(spark):
    r = random.Random(4)
    side = lambda a, b: [(v, i, s := r.uniform(0, 100), s + r.uniform(0.1, 30)) for v in range(3) for i in range(25)]
    left, right = side(0, 1), side(0, 1)
    a = spark.createDataFrame(left, "video_id long, v_pos long, v_start double, v_end double")
    b = spark.createDataFrame(right, "video_id long, h_pos long, h_start double, h_end double")
    got = sorted((x.video_id, x.v_pos, x.h_pos) for x in joins.overlap_join(a, b, 8.0, 1.5).collect())
    assert got == sorted((v, i, j) for v, i, s, e in left for u, j, t, f in right if v == u and s - 1.5 < f and t - 1.5 < e)


def test_nearest_equals_brute_force(spark):
    r = random.Random(5)
    left = [(v, r.randrange(200)) for v in range(4) for _ in range(30)]
    right = [(v, r.randrange(200)) for v in range(3) for _ in range(10)]
    got = joins.nearest(spark.createDataFrame(left, "video_id long, t_ms long"), spark.createDataFrame(right, "video_id long, t_ms long"), 9).collect()
    want = []
    for v, t in left:
        best = min((u for k, u in right if k == v), key=lambda u: (abs(u - t), u), default=None)
        want.append((v, t, None if best is None or abs(best - t) > 9 else best - t))
    assert sorted(((x.video_id, x.t_ms, x.n_off) for x in got), key=str) == sorted(want, key=str)


def test_folds_equal_loops(spark):
    r = random.Random(6)
    rows = [(v, i) for v in range(5) for i in sorted(r.sample(range(200), 40))]
    want, last = [], {}
    for v, i in rows:
        if v not in last or i - last[v] >= 9:
            want.append((v, i))
            last[v] = i
    assert sorted(map(tuple, folds.spaced(spark.createDataFrame(rows, "video_id long, idx long"), "idx", 9).collect())) == want
    assert [x.idx for x in folds.spaced(spark.createDataFrame([(0, i) for i in (0, 2, 4, 6)], "video_id long, idx long"), "idx", 4).collect()] == [0, 4]

    marks = [(v, i, r.getrandbits(6), float(i), 1.0, r.random() < 0.1, 5.0) for v in range(4) for i in range(30)]
    kept, want = {}, []
    for v, i, h, cum, own, forced, tol in marks:
        again = any(bin(h ^ k[0]).count("1") <= 1 and cum - k[1] + 1.0 <= tol for k in kept.get(v, []))
        if forced or not again:
            kept.setdefault(v, []).append((h, cum))
            want.append((v, i))
    df = spark.createDataFrame(marks, "video_id long, idx long, dhash long, cum double, own double, forced boolean, tolerance double")
    assert sorted((x.video_id, x.idx) for x in folds.near_duplicates_removed(df, 1).collect()) == want


def motion(spark, line, cuts=()):
    rows = [(0, i, i * 100, float(s), i in cuts) for i, s in enumerate(line)]
    return spark.createDataFrame(rows, "video_id long, idx long, t_ms long, score double, is_scene_cut boolean")


def test_sampling_invariants(spark):
    r = random.Random(7)
    still, lively = [0.01] * 50, [r.uniform(0.5, 1) for _ in range(50)]
    rows = motion(spark, still + lively, cuts=(50, 70, 90))
    got = sampling.chosen_frames(rows, 16, 0.25).collect()
    assert len({x.idx for x in got}) == len(got) <= 16
    assert {50, 70, 90} <= {x.idx for x in got if x.reason == "scene_cut"}
    assert sum(x.idx >= 50 for x in got) > sum(x.idx < 50 for x in got) > 0
    assert sampling.quota_cuts(motion(spark, lively, cuts=range(50)), 8).count() == 4
    flat = sorted(x.idx for x in sampling.chosen_frames(motion(spark, [0.0] * 100), 10, 0.25).collect())
    assert flat == [5 + 10 * k - 1 for k in range(10)] or max(b - a for a, b in zip(flat, flat[1:])) == 10
    stats = sampling.gap_statistics(motion(spark, [0.0] * 4)).first()
    assert (stats.frames, stats.max_gap_ms, stats.mean_gap_ms) == (4, 100, 100)


def test_scene_change_needs_structure(spark):
    still, other = 0, (1 << 40) - 1
    rows = [(0, i, i * 66, 0.9 if i == 15 else 0.0, other if i >= 15 else still) for i in range(30)] + [(1, i, i * 66, 0.9 if i == 15 else 0.0, still) for i in range(30)]
    df = spark.createDataFrame(rows, "video_id long, idx long, t_ms long, score double, dhash long").withColumn("score", F.col("score").cast("float"))
    assert [tuple(x) for x in profile.scene_cuts(df).collect()] == [(0, 15)]


def test_slices_swap_bounds(spark):
    rows = motion(spark, [0.1] * 20)
    ranges = spark.createDataFrame([(0, 1, 1000, 500), (0, 2, 5000, 6000)], "video_id long, range_id long, a long, b long")
    got = profile.sliced(rows, ranges)
    assert {x.range_id for x in got.collect()} == {1} and sorted(x.t_ms for x in got.collect()) == [500, 600, 700, 800, 900, 1000]


def test_caps_and_plans(spark):
    rows = spark.createDataFrame([(0, i, 0.9, False) for i in range(10)] + [(0, 10 + i, 0.1, True) for i in range(3)], "video_id long, pos long, confidence double, is_safety boolean")
    got = segments.capped(rows, 5, ["pos"]).collect()
    assert sum(x.is_safety for x in got) == 3 and len(got) == 5 and all(x.truncated for x in got)
    assert {x.pos for x in segments.capped(rows, 2, ["pos"]).collect()} == {10, 11}
    plan = segments.segment_plan(spark.createDataFrame([(0, 600_000), (1, 100)], "video_id long, duration_ms long"), 260_000, 10_000)
    assert [(x.video_id, x.t0, x.t1) for x in plan.orderBy("video_id", "seq").collect()] == [(0, 0, 260_000), (0, 250_000, 510_000), (0, 500_000, 600_000), (1, 0, 100)]
    assert segments.chunk_overlaps(plan).count() == 2


def test_metrics(spark):
    truth = spark.createDataFrame([(0, 100), (0, 900), (1, 5)], "video_id long, t_ms long")
    picks = spark.createDataFrame([(0, 110), (0, 500)], "video_id long, t_ms long")
    got = {x.video_id: (x.total, x.covered, x.worst_miss, x.mean_offset) for x in metrics.video_metrics(truth, picks, 50).collect()}
    assert got == {0: (2, 1, 400, 10), 1: (1, 0, None, None)}
    assert metrics.corpus_metrics(metrics.video_metrics(truth, picks, 50)).first().recall == pytest.approx(1 / 3)
    assert metrics.corpus_metrics(metrics.video_metrics(truth.limit(0), picks, 50)).first().recall == 1.0
    runs = spark.createDataFrame([("a", 0, "x", 3, False), ("a", 1, "x", 5, False), ("a", 0, "y", 1, True), ("a", 1, "y", 1, True)], "variant string, run long, name string, matched long, error boolean")
    s = metrics.run_statistics(runs).first()
    assert (s.runs, s.mean, s.spread, s.errors) == (2, 4.0, 2, 2)
    assert {x.name: x.stability for x in metrics.stability(runs).collect()} == {"x": "volatile", "y": "always_error"}
