"""Queries on profiles, sampling, windows and fingerprints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import checks, clock
from sightline.functions.bits import hamming
from sightline.functions.stats import floor_rank_index
from sightline.functions.text import block_level
from sightline.operators import folds, joins, profile, sampling, segments
from sightline.plans import sql as S
from sightline.plans.book import Book
from sightline.sources import views

Q = Book()
DAY = 86_400_000
r6 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)


@Q(f"WITH {S.PROFILE} SELECT video_id, idx, t_ms, raw, round(score::DOUBLE, 6) AS score FROM prof")
def a06_profile_scores(spark, folder):
    return views.profile(spark, folder).select("video_id", "idx", "t_ms", "raw", r6("score"))


@Q(f"WITH {S.PROFILE} SELECT video_id, (t_ms // {DAY}) * {DAY} AS t_ms, round(max(score)::DOUBLE, 6) AS score, bool_or(is_scene_cut) AS is_scene_cut FROM prof GROUP BY ALL")
def a08_profile_bucketed(spark, folder):
    return profile.bucketed(views.profile(spark, folder), DAY).select("video_id", "t_ms", r6("score"), "is_scene_cut")


@Q(f"WITH {S.PROFILE} SELECT video_id, count(*) AS samples, round(sum(score::DOUBLE), 6) AS total, round(avg(score::DOUBLE), 6) AS mean, round(max(score::DOUBLE), 6) AS peak, count(*) FILTER (WHERE is_scene_cut) AS cuts FROM prof GROUP BY video_id")
def a07_profile_totals(spark, folder):
    return profile.totals(views.profile(spark, folder)).select("video_id", "samples", r6("total"), r6("mean"), r6("peak"), "cuts")


@Q(f"WITH {S.FRAMES} SELECT video_id, idx, round(abs(coalesce(raw - lag(raw) OVER (PARTITION BY video_id ORDER BY idx), 0)), 6) AS diff FROM frames")
def w01_frame_difference(spark, folder):
    return profile.frame_difference(views.frames(spark, folder), F.col("raw")).select("video_id", "idx", r6("diff"))


_BASELINE = f"""WITH {S.MARKED}, b AS (SELECT *, list(score::DOUBLE) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS l FROM mprof),
based AS (SELECT *, CASE WHEN len(l) > 0 THEN list_sort(l)[CAST(floor((len(l) - 1) * 0.5 + 0.5) AS INT) + 1] END AS baseline FROM b),
stepped AS (SELECT *, CAST(abs(score::DOUBLE - baseline) AS FLOAT) AS step, max(score) OVER (PARTITION BY video_id) AS most,
 bit_count(xor(dhash, lag(dhash) OVER (PARTITION BY video_id ORDER BY idx))) AS moved FROM based)"""


@Q(_BASELINE + " SELECT video_id, idx, round(baseline, 6) AS baseline, round(step::DOUBLE, 6) AS step FROM stepped")
def w02_trailing_baseline(spark, folder):
    return profile.with_baseline(views.profile(spark, folder), 15).select("video_id", "idx", r6("baseline"), r6("step"))


_CANDIDATES = _BASELINE + ", cand AS (SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS rn FROM stepped WHERE most > 0 AND step > CAST(most * 0.5::FLOAT AS FLOAT) AND moved >= 16)"


@Q(_CANDIDATES + " SELECT video_id, idx FROM cand")
def w03_cut_candidates(spark, folder):
    return profile.cut_candidates(views.fingerprinted_profile(spark, folder), 15, 0.5, 16).select("video_id", "idx")


@Q(
    _CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, walk AS (SELECT video_id, rn, idx, true AS kept, idx AS last FROM cand WHERE rn = 1 UNION ALL
SELECT c.video_id, c.rn, c.idx, c.idx - w.last >= 15, CASE WHEN c.idx - w.last >= 15 THEN c.idx ELSE w.last END FROM walk w JOIN cand c ON c.video_id = w.video_id AND c.rn = w.rn + 1)
SELECT video_id, idx FROM walk WHERE kept"""
)
def g01_scene_cuts(spark, folder):
    return profile.scene_cuts(views.fingerprinted_profile(spark, folder))


_RANGES = "ranges AS (SELECT video_id, r AS range_id, CASE WHEN r = 0 THEN m // 4 ELSE m * 3 // 4 END AS a, CASE WHEN r = 0 THEN m // 2 ELSE m // 2 END AS b FROM (SELECT video_id, max(t_ms) AS m FROM prof GROUP BY video_id), (VALUES (0::BIGINT), (1::BIGINT)) v(r))"


def _ranges(rows):
    ends = rows.groupBy("video_id").agg(F.max("t_ms").alias("m"))
    return ends.select("video_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("range_id"), F.expr("m div 4").alias("a"), F.expr("m div 2").alias("b")), F.struct(F.lit(1).cast("long").alias("range_id"), F.expr("m * 3 div 4").alias("a"), F.expr("m div 2").alias("b")))).alias("r")).select("video_id", "r.*")


@Q(f"WITH {S.PROFILE}, {_RANGES} SELECT p.video_id, range_id, idx, t_ms, round(score::DOUBLE, 6) AS score FROM prof p JOIN ranges r ON p.video_id = r.video_id AND t_ms BETWEEN least(a, b) AND greatest(a, b)")
def p01_slice(spark, folder):
    rows = views.profile(spark, folder)
    return profile.sliced(rows, _ranges(rows)).select("video_id", "range_id", "idx", "t_ms", r6("score"))


@Q(f"WITH {S.PROFILE}, {_RANGES} SELECT p.video_id, range_id, count(*) AS samples, max(t_ms) - min(t_ms) + 67 AS duration_ms FROM prof p JOIN ranges r ON p.video_id = r.video_id AND t_ms BETWEEN least(a, b) AND greatest(a, b) GROUP BY ALL")
def p01_slice_duration(spark, folder):
    rows = views.profile(spark, folder)
    return profile.slice_duration(profile.sliced(rows, _ranges(rows)), 15.0)


@Q(f"WITH {S.PROFILE} SELECT video_id, idx, t_ms FROM prof WHERE is_scene_cut")
def p02_cut_filter(spark, folder):
    return views.profile(spark, folder).filter("is_scene_cut").select("video_id", "idx", "t_ms")


@Q(f"WITH {S.PROFILE} SELECT video_id, idx, t_ms FROM prof WHERE idx % 4 = 0")
def p03_stride(spark, folder):
    return profile.strided(views.profile(spark, folder), 15.0, 4.0).select("video_id", "idx", "t_ms")


_WEIGHTS = f"""WITH {S.PROFILE}, floors AS (SELECT video_id, list_sort(list(score::DOUBLE))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS INT) + 1] AS fl FROM prof GROUP BY video_id),
e AS (SELECT p.*, greatest(score::DOUBLE - fl, 0.0) AS eff FROM prof p JOIN floors USING (video_id)),
s AS (SELECT *, sum(eff) OVER (PARTITION BY video_id) AS total, count(*) OVER (PARTITION BY video_id) AS n FROM e),
wt AS (SELECT *, CASE WHEN total > 0 THEN 0.75::DOUBLE * (eff / total) ELSE 0.0 END + 0.25::DOUBLE / n AS weight FROM s),
cdf AS (SELECT *, sum(weight) OVER (PARTITION BY video_id ORDER BY idx) AS cum FROM wt)"""


@Q(_WEIGHTS + " SELECT video_id, idx, round(eff, 6) AS eff, round(weight, 6) AS weight, round(cum, 6) AS cum FROM cdf")
def w05_weights(spark, folder):
    return sampling.weighted(views.profile(spark, folder), 0.25).select("video_id", "idx", r6("eff"), r6("weight"), r6("cum"))


_PICKS = """, bounds AS (SELECT video_id, idx, coalesce(lag(cum) OVER (PARTITION BY video_id ORDER BY idx), -1.0) AS low,
 CASE WHEN lead(cum) OVER (PARTITION BY video_id ORDER BY idx) IS NULL THEN 1e300 ELSE cum END AS high, max(cum) OVER (PARTITION BY video_id) AS whole FROM cdf)"""


@Q(_WEIGHTS + _PICKS + " SELECT video_id, j, idx FROM bounds, range(16) t(j) WHERE low < (j + 0.5::DOUBLE) / 16 * whole AND (j + 0.5::DOUBLE) / 16 * whole <= high")
def j06_inverse_cdf(spark, folder):
    rows = views.profile(spark, folder)
    targets = rows.select("video_id").distinct().withColumn("n_targets", F.lit(16))
    return sampling.inverse_cdf_picks(sampling.weighted(rows, 0.25), targets)


@Q(f"WITH {S.PROFILE} SELECT video_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, idx) AS nth FROM prof WHERE is_scene_cut) WHERE nth <= 8")
def g05_cut_quota(spark, folder):
    return sampling.quota_cuts(views.profile(spark, folder), 16)


_CHOSEN = (
    _WEIGHTS
    + _PICKS
    + """, cuts AS (SELECT video_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, idx) AS nth FROM prof WHERE is_scene_cut) WHERE nth <= 8),
nt AS (SELECT v.video_id, 16 - count(c.idx) AS n FROM (SELECT DISTINCT video_id FROM prof) v LEFT JOIN cuts c USING (video_id) GROUP BY v.video_id),
picks AS (SELECT DISTINCT b.video_id, idx FROM bounds b JOIN nt USING (video_id), range(16) t(j) WHERE j < n AND low < (j + 0.5::DOUBLE) / n * whole AND (j + 0.5::DOUBLE) / n * whole <= high),
chosen AS (SELECT video_id, idx, 'scene_cut' AS reason FROM cuts UNION ALL SELECT video_id, idx, 'motion' FROM picks p WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.video_id = p.video_id AND c.idx = p.idx))"""
)


@Q(_CHOSEN + " SELECT * FROM chosen")
def g05_chosen_frames(spark, folder):
    return sampling.chosen_frames(views.profile(spark, folder), 16, 0.25)


@Q(_CHOSEN + " SELECT video_id, count(*) FILTER (WHERE reason = 'scene_cut') AS cuts FROM chosen GROUP BY video_id")
def p19_chosen_cuts(spark, folder):
    return sampling.chosen_frames(views.profile(spark, folder), 16, 0.25).groupBy("video_id").agg(F.count_if(F.col("reason") == "scene_cut").alias("cuts"))


@Q(
    _CHOSEN
    + """, g AS (SELECT video_id, t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY t_ms) AS gap FROM chosen JOIN prof USING (video_id, idx))
SELECT video_id, count(*) AS frames, coalesce(max(gap), 0)::BIGINT AS max_gap_ms, coalesce(sum(gap) // nullif(count(gap), 0), 0)::BIGINT AS mean_gap_ms FROM g GROUP BY video_id"""
)
def a13_gap_statistics(spark, folder):
    rows = views.profile(spark, folder)
    return sampling.gap_statistics(sampling.chosen_frames(rows, 16, 0.25).join(rows.select("video_id", "idx", "t_ms"), ["video_id", "idx"]))


_PICK = f""", {S.MARKS}, pick AS (SELECT c.video_id, c.idx, c.reason, f.t_ms, m.dhash, e.eff, e.em, e.tol, c.reason = 'scene_cut' AS forced, row_number() OVER (PARTITION BY c.video_id ORDER BY c.idx) AS rn
 FROM chosen c JOIN frames f ON f.video_id = c.video_id AND f.idx = c.idx
 JOIN (SELECT video_id, idx, eff, sum(eff) OVER (PARTITION BY video_id ORDER BY idx) AS em, total / 16 * 0.1::DOUBLE AS tol FROM s) e ON e.video_id = c.video_id AND e.idx = c.idx
 JOIN marks m ON m.vec_id = (c.video_id * 31 + c.idx) % (SELECT count(*) FROM embeddings)),"""
_WALK = """walk AS (SELECT video_id, rn, [{'h': dhash, 'em': em, 'eff': eff}] AS kept, idx, t_ms, reason, true AS keep FROM pick WHERE rn = 1 UNION ALL
SELECT p.video_id, p.rn, CASE WHEN p.forced OR len([k FOR k IN w.kept IF bit_count(xor(k.h, p.dhash)) <= 24 AND MOTION]) = 0 THEN list_append(w.kept, {'h': p.dhash, 'em': p.em, 'eff': p.eff}) ELSE w.kept END, p.idx, p.t_ms, p.reason,
 p.forced OR len([k FOR k IN w.kept IF bit_count(xor(k.h, p.dhash)) <= 24 AND MOTION]) = 0 FROM walk w JOIN pick p ON p.video_id = w.video_id AND p.rn = w.rn + 1)"""
_SELECTED = _CHOSEN.replace("WITH ", "WITH RECURSIVE ", 1) + _PICK + _WALK.replace("MOTION", "p.em - k.em + k.eff <= p.tol")
HOW = sampling.Sampling(16, 0.25, 24)


@Q(_CHOSEN.replace("WITH ", "WITH RECURSIVE ", 1) + _PICK + _WALK.replace("MOTION", "true") + " SELECT video_id, idx FROM walk WHERE keep")
def g04_near_dup(spark, folder):
    """Near duplicates among the frames that a budget of 16 chose, whatever the motion between them."""
    rows = views.fingerprinted_profile(spark, folder)
    chosen = sampling.chosen_frames(rows, 16, 0.25).withColumn("forced", F.col("reason") == "scene_cut").join(rows.select("video_id", "idx", "dhash"), ["video_id", "idx"])
    return folds.near_duplicates_removed(chosen.withColumn("cum", F.lit(0.0)).withColumn("own", F.lit(0.0)), 24, F.lit(1e9)).select("video_id", "idx")


@Q(_SELECTED + " SELECT video_id, idx FROM walk WHERE keep")
def g04_near_dup_chosen(spark, folder):
    """The fold over the frames that a budget of 16 chose from whole recordings; a tenth of a step's motion is tolerated."""
    rows = views.fingerprinted_profile(spark, folder)
    return sampling.chosen_without_near_duplicates(rows, 16, 0.25, 24)


@Q(_SELECTED + " SELECT w.video_id, w.idx, w.t_ms, reason, keep AS kept, round(score::DOUBLE, 6) AS score FROM walk w JOIN prof p ON p.video_id = w.video_id AND p.idx = w.idx")
def g05_selected_frames(spark, folder):
    """The whole frame selection: forced cuts, motion picks, near duplicates marked."""
    return sampling.selected_frames(views.fingerprinted_profile(spark, folder), HOW).select("video_id", "idx", "t_ms", "reason", "kept", r6("score"))


@Q(
    _SELECTED
    + """, g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY rn) AS gap FROM walk), k AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY rn) AS gap FROM walk WHERE keep),
b AS (SELECT video_id, 16 - count(*) FILTER (WHERE reason = 'scene_cut') AS sampled_budget, count(*) FILTER (WHERE reason = 'scene_cut') AS cuts, count(*) FILTER (WHERE NOT keep) AS dropped_duplicates, coalesce(max(gap), 0)::BIGINT AS max_gap_before_dedup_ms FROM g GROUP BY video_id),
a AS (SELECT video_id, count(*) AS frames, coalesce(max(gap), 0)::BIGINT AS max_gap_ms, coalesce(sum(gap) // nullif(count(gap), 0), 0)::BIGINT AS mean_gap_ms FROM k GROUP BY video_id)
SELECT video_id, 16::BIGINT AS budget, sampled_budget, frames, cuts, dropped_duplicates, max_gap_before_dedup_ms, max_gap_ms, mean_gap_ms FROM b JOIN a USING (video_id)"""
)
def g05_selection(spark, folder):
    """What the whole frame selection says of each recording: counts, and gaps before and after near duplicates go."""
    return sampling.selection_statistics(sampling.selected_frames(views.fingerprinted_profile(spark, folder), HOW), HOW)


@Q(
    f"""WITH {S.FRAMES}, n AS (SELECT video_id, count(*) AS samples, video_id % 4 AS k FROM frames GROUP BY video_id)
SELECT video_id, CASE WHEN k = 0 THEN 'empty_profile' WHEN k = 1 THEN 'no_budget' WHEN k = 2 THEN 'bad_alpha' END AS error FROM n"""
)
def p06_sampling_errors(spark, folder):
    """Sampling configurations that can't be used."""
    rows, k = views.frames(spark, folder).groupBy("video_id").agg(F.count("*").alias("samples")), F.col("video_id") % 4
    error = checks.sampling_error(F.when(k == 0, 0).otherwise(F.col("samples")), F.when(k == 1, 0).otherwise(16), F.when(k == 2, F.lit(1.5)).otherwise(F.lit(0.25)))
    return rows.select("video_id", error.alias("error"))


@Q(f"WITH {S.MARKS} SELECT vec_id, bit_count(xor(dhash, lag(dhash) OVER (ORDER BY vec_id)))::INT AS distance FROM marks QUALIFY distance IS NOT NULL")
def f17_hamming(spark, folder):
    """Distances between neighbours by id, met by an equality and not by a window over everything."""
    marks = views.fingerprints(spark, folder)
    before = marks.select((F.col("vec_id") + 1).alias("vec_id"), F.col("dhash").alias("before"))
    return marks.join(before, "vec_id").select("vec_id", hamming(F.col("before"), F.col("dhash")).alias("distance"))


_VIDEOS = "videos AS (SELECT video_id, count(*) AS n_frames, max(t_ms) + 67 AS duration_ms FROM frames GROUP BY video_id)"


def _videos(spark, folder):
    return views.frames(spark, folder).groupBy("video_id").agg(F.count("*").alias("n_frames"), (F.max("t_ms") + 67).alias("duration_ms"))


@Q(f"WITH {S.FRAMES}, {_VIDEOS} SELECT video_id, w, w * 5 AS \"first\", least(w * 5 + 20, n_frames) AS \"last\" FROM videos, range(100000) t(w) WHERE w < CASE WHEN n_frames <= 20 THEN 1 ELSE CAST(ceil((n_frames - 20) / 5.0) AS BIGINT) + 1 END")
def x01_sliding(spark, folder):
    return segments.sliding_windows(_videos(spark, folder), 20, 5)


@Q(f"WITH {S.FRAMES} SELECT video_id, (t_ms // 3600000) * 3600000 AS t_ms, count(*) AS n, max(raw) AS top FROM frames GROUP BY ALL")
def x02_tumbling(spark, folder):
    start = (F.floor(F.col("t_ms") / 3_600_000) * 3_600_000).alias("t_ms")
    return views.frames(spark, folder).groupBy("video_id", start).agg(F.count("*").alias("n"), F.max("raw").alias("top"))


_PLAN = f"WITH {S.FRAMES}, {_VIDEOS}, plan AS (SELECT video_id, s AS seq, s * 250000000 AS t0, least(s * 250000000 + 260000000, duration_ms) AS t1 FROM videos, range(100) t(s) WHERE s < CASE WHEN duration_ms <= 260000000 THEN 1 ELSE CAST(ceil((duration_ms - 260000000) / 250000000.0) AS BIGINT) + 1 END)"


@Q(_PLAN + " SELECT * FROM plan")
def x04_segment_plan(spark, folder):
    return segments.segment_plan(_videos(spark, folder), 260_000_000, 10_000_000)


@Q(_PLAN + " SELECT video_id, a, b FROM (SELECT video_id, lead(t0) OVER (PARTITION BY video_id ORDER BY seq) AS a, t1 AS b FROM plan) WHERE a < b")
def w14_chunk_overlaps(spark, folder):
    return segments.chunk_overlaps(segments.segment_plan(_videos(spark, folder), 260_000_000, 10_000_000))


@Q(
    _PLAN.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, lap AS (SELECT video_id, a, b FROM (SELECT video_id, lead(t0) OVER (PARTITION BY video_id ORDER BY seq) AS a, t1 AS b FROM plan) WHERE a < b),
e AS (SELECT video_id, t_ms, event_id AS pos, EXISTS (SELECT 1 FROM lap l WHERE l.video_id = f.video_id AND f.t_ms BETWEEN a AND b) AS in_overlap FROM frames f WHERE event_type IN ('error', 'purchase')),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_ms, pos) AS rn FROM e),
walk AS (SELECT video_id, rn, t_ms, pos, true AS keep, t_ms AS last FROM n WHERE rn = 1 UNION ALL
SELECT n.video_id, n.rn, n.t_ms, n.pos, NOT (n.in_overlap AND n.t_ms - w.last <= 21600000), CASE WHEN n.in_overlap AND n.t_ms - w.last <= 21600000 THEN w.last ELSE n.t_ms END FROM walk w JOIN n ON n.video_id = w.video_id AND n.rn = w.rn + 1)
SELECT video_id, t_ms, pos FROM walk WHERE keep"""
)
def g02_chunk_dedup(spark, folder):
    laps = segments.chunk_overlaps(segments.segment_plan(_videos(spark, folder), 260_000_000, 10_000_000))
    rows = views.frames(spark, folder).filter("event_type in ('error', 'purchase')").select("video_id", "t_ms", F.col("event_id").alias("pos"))
    inside = joins.points_in_ranges(rows, laps, 3_600_000, "left_semi").select("video_id", "pos").withColumn("_in", F.lit(True))
    return folds.chunk_deduplicated(rows.join(inside, ["video_id", "pos"], "left").withColumn("in_overlap", F.coalesce("_in", F.lit(False))), 21_600_000)


@Q(
    f"WITH {S.PROFILE}, params(threshold) AS (VALUES (0.1::DOUBLE), (0.35::DOUBLE), (0.7::DOUBLE)) SELECT threshold, video_id, count(*) FILTER (WHERE score >= threshold) AS hits, round(max(score)::DOUBLE, 6) AS peak FROM prof, params GROUP BY ALL"
)
def u07_sweep(spark, folder):
    """A sweep of three parameters as one job: the parameter is one more grouping column."""
    params = spark.createDataFrame([(0.1,), (0.35,), (0.7,)], "threshold double")
    rows = views.profile(spark, folder).crossJoin(F.broadcast(params))
    return rows.groupBy("threshold", "video_id").agg(F.count_if(F.col("score").cast("double") >= F.col("threshold")).alias("hits"), F.round(F.max("score").cast("double"), 6).alias("peak"))


@Q(f"WITH {S.FRAMES}, c AS (SELECT video_id, list_sort(list(raw)) AS l FROM frames WHERE raw > 0 GROUP BY video_id) SELECT video_id, greatest(l[least(CAST(floor(len(l) * 0.99) AS INT), len(l) - 1) + 1], 1.0) AS top FROM c")
def a26_floor_p99(spark, folder):
    """By the rank in a sorted window, which spills."""
    whole = Window.partitionBy("video_id")
    rows = views.frames(spark, folder).filter("raw > 0").withColumn("n", F.count("*").over(whole)).withColumn("at", F.row_number().over(whole.orderBy("raw")) - 1)
    picked = rows.filter(F.col("at") == floor_rank_index(F.col("n"), 0.99))
    return picked.select("video_id", F.greatest("raw", F.lit(1.0)).alias("top"))


@Q(
    f"WITH {S.PROFILE}, b AS (SELECT video_id, t_ms // {DAY} AS day, max(score) AS score FROM prof GROUP BY ALL) SELECT video_id, string_agg(substring('▁▂▃▄▅▆▇█', least(greatest(CAST(floor(score::DOUBLE * 7) AS INT), 0), 7) + 1, 1), '' ORDER BY day) AS line FROM b GROUP BY video_id"
)
def k10_sparkline(spark, folder):
    rows = profile.bucketed(views.profile(spark, folder), DAY).withColumn("level", block_level(F.col("score").cast("double")))
    ordered = F.array_sort(F.collect_list(F.struct("t_ms", "level")))
    return rows.groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda x: x["level"]), "").alias("line"))


@Q(
    f"""WITH {S.FRAMES} SELECT video_id, idx, coalesce((SELECT min(c) FROM (VALUES (1000), (2000), (5000), (10000), (15000), (30000), (60000), (120000), (300000), (600000)) v(c) WHERE c >= (t_ms // 1000) // 10), 600000)::BIGINT AS tick FROM frames"""
)
def t11_tick(spark, folder):
    """The interval between ticks of a chart that lasts as many milliseconds as the frame's time has seconds."""
    return views.frames(spark, folder).select("video_id", "idx", clock.tick_interval(F.expr("t_ms div 1000")).alias("tick"))


@Q(f"WITH {S.FRAMES} SELECT video_id, idx, sum(raw > 50) OVER (PARTITION BY video_id ORDER BY idx)::BIGINT AS used, sum(raw > 50) OVER (PARTITION BY video_id ORDER BY idx) <= 3 AS allowed FROM frames")
def w17_counter(spark, folder):
    line = Window.partitionBy("video_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("raw") > 50, 1).otherwise(0)).over(line)
    return views.frames(spark, folder).select("video_id", "idx", used.alias("used"), (used <= 3).alias("allowed"))
