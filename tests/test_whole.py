"""Queries over whole tables: as many rows as the tables have, and sampling against a fold in Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import sampling
from sightline.plans.registry import QUERIES
from sightline.sources import views

FOLDER = "/root/testdata/sf0.001"


def run(spark, name):
    return QUERIES[name](spark, FOLDER)


def test_near_duplicates_of_the_chosen_frames(spark):
    rows = views.fingerprinted_profile(spark, FOLDER)
    eff = {}
    for x in sampling.weighted(rows, 0.25).select("video_id", "idx", "eff").collect():
        eff.setdefault(x.video_id, {})[x.idx] = x.eff
    chosen = sampling.chosen_frames(rows, 16, 0.25).join(rows.select("video_id", "idx", "dhash"), ["video_id", "idx"]).orderBy("video_id", "idx").collect()
    kept = {}
    for x in chosen:
        own = eff[x.video_id]
        near = lambda k: bin((k[1] ^ x.dhash) & (1 << 64) - 1).count("1") <= 24 and sum(own[i] for i in range(k[0], x.idx + 1)) <= sum(own.values()) / 16 * 0.1  # noqa: E731, B023
        if x.reason == "scene_cut" or not any(near(k) for k in kept.get(x.video_id, [])):
            kept.setdefault(x.video_id, []).append((x.idx, x.dhash))
    got = sorted((x.video_id, x.idx) for x in run(spark, "g04_near_dup_chosen").collect())
    assert got == sorted((v, i) for v, l in kept.items() for i, _ in l)
    assert any(i >= 40 for _, i in got)


def test_targets_that_fall_on_a_row(spark):
    """Recordings that are still in their first and last eighth: targets 0 and 15 fall on the ends of these, so rounding decides;
    weights are added one by one, in order, as the reference does."""
    r, rows, want, ties = random.Random(3), [], set(), 0
    for v in range(60):
        n = r.choice((48, 56, 64, 120))
        scores = [0.0] * (n // 8) + [float(np.float32(r.random())) for _ in range(n - n // 4)] + [0.0] * (n // 8)
        eff = [max(s - sorted(scores)[n // 2], 0.0) for s in scores]
        rows += [(v, i, s) for i, s in enumerate(scores)]
        cum = list(itertools.accumulate(0.75 * (e / sum(eff)) + 0.25 / n for e in eff))
        want |= {(v, j, next((i for i in range(n) if cum[i] >= (j + 0.5) / 16 * cum[-1]), n - 1)) for j in range(16)}
        ties += sum(any(abs(c - (j + 0.5) / 16 * cum[-1]) < 1e-12 for c in cum) for j in (0, 15))
    profile = spark.createDataFrame(rows, "video_id long, idx long, score float")
    targets = profile.select("video_id").distinct().withColumn("n_targets", F.lit(16))
    got = {tuple(x) for x in sampling.inverse_cdf_picks(sampling.weighted(profile, 0.25), targets).collect()}
    assert ties == 120 and got == want


def test_whole_selection(spark):
    how = sampling.Sampling(16, 0.25, 24)
    rows = views.fingerprinted_profile(spark, FOLDER)
    frames = sampling.selected_frames(rows, how).cache()
    told = {x.video_id: x for x in sampling.selection_statistics(frames, how).collect()}
    assert sorted((x.video_id, x.idx) for x in frames.filter("kept").collect()) == sorted((x.video_id, x.idx) for x in run(spark, "g04_near_dup_chosen").collect())
    for x in told.values():
        own = sorted((y.t_ms, y.kept, y.reason) for y in frames.filter(F.col("video_id") == x.video_id).collect())
        kept = [t for t, k, _ in own if k]
        gaps, all_gaps = ([b - a for a, b in zip(ts, ts[1:])] for ts in (kept, [t for t, _, _ in own]))
        assert (x.frames, x.dropped_duplicates, x.max_gap_ms, x.max_gap_before_dedup_ms) == (len(kept), len(own) - len(kept), max(gaps, default=0), max(all_gaps, default=0))
        assert x.sampled_budget == 16 - sum(r == "scene_cut" for _, _, r in own) and x.mean_gap_ms == (sum(gaps) // len(gaps) if gaps else 0)
        assert x.frames <= 16 and x.cuts <= 8
    # a still picture: all picks look alike and nothing moves between them
    still = spark.range(40).selectExpr("1L as video_id", "id as idx", "id * 100 as t_ms", "cast(0.1 as float) as score", "id = 20 as is_scene_cut", "7L as dhash")
    x = sampling.selection_statistics(sampling.selected_frames(still, how), how).first()
    assert (x.cuts, x.frames, x.dropped_duplicates, x.sampled_budget) == (1, 2, 13, 15) and x.max_gap_before_dedup_ms < x.max_gap_ms
    free = sampling.selected_frames(rows, sampling.Sampling(16, 0.25, 0, force_cuts=False))
    assert free.filter("not kept or reason <> 'motion'").isEmpty()
    for bad in (sampling.Sampling(0), sampling.Sampling(alpha=1.5), sampling.Sampling(alpha=float("nan"))):
        with pytest.raises(ValueError):
            sampling.selected_frames(rows, bad)


def test_all_customers(spark):
    customers = views.table(spark, FOLDER, "customer")
    prompts = run(spark, "f25_fragments")
    assert prompts.agg(F.sum(F.size(F.split("prompt", "\n\n")))).first()[0] == customers.count()
    members = customers.join(views.table(spark, FOLDER, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey").distinct(), "c_nationkey")
    assert sorted(x.viewer for x in run(spark, "j13_permissions").collect()) == sorted(x.c_custkey for x in members.collect())


def test_all_names_and_events(spark):
    names = [x.o_custkey for x in views.table(spark, FOLDER, "orders").select("o_custkey").distinct().orderBy("o_custkey").collect()]
    assert [(x.id, x.name) for x in run(spark, "q04_ordered_scan").orderBy("id").collect()] == list(enumerate(names, 1))
    assert run(spark, "t01_event_order").count() == run(spark, "a09_segments").count()
