"""Motion profiles of many recordings at once: normalisation, baselines, scene changes, roll-ups.

Frames have video_id, idx (0, 1, ... in a recording), t_ms and raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.bits import hamming
from sightline.functions.stats import at_rank, with_nearest_rank
from sightline.operators.folds import spaced
from sightline.operators.joins import points_in_ranges


def _video():
    return Window.partitionBy("video_id")


def _line():
    return _video().orderBy("idx")


def normalised(frames: DataFrame, p: float = 0.99) -> DataFrame:
    """frames with score: raw over the recording's p-th percentile (nearest rank), at most 1, in single precision; 0 where that is 0."""
    ranked = with_nearest_rank(frames, ["video_id"], "raw", p, "_top", "idx")
    score = F.when(F.col("_top") > 0, F.least(F.col("raw") / F.col("_top"), F.lit(1.0))).otherwise(F.lit(0.0))
    return ranked.withColumn("score", score.cast("float")).drop("_top")


def bucketed(profile: DataFrame, ms: int) -> DataFrame:
    """(video_id, t_ms, score, is_scene_cut): the largest score and any cut of each bucket that has samples; none for ms 0."""
    if ms <= 0:
        return profile.select("video_id", "t_ms", "score", "is_scene_cut").limit(0)
    start = (F.floor(F.col("t_ms") / ms) * ms).alias("t_ms")
    return profile.groupBy("video_id", start).agg(F.max("score").alias("score"), F.bool_or("is_scene_cut").alias("is_scene_cut"))


def with_baseline(profile: DataFrame, window: int) -> DataFrame:
    """profile with baseline, the upper median of up to `window` scores before (null for the first), and step, the distance to it."""
    before = F.collect_list(F.col("score").cast("double")).over(_line().rowsBetween(-window, -1))
    out = profile.withColumn("baseline", at_rank(before))
    return out.withColumn("step", F.abs(F.col("score").cast("double") - F.col("baseline")).cast("float"))


def cut_candidates(profile: DataFrame, window: int, ratio: float, least_bits: int) -> DataFrame:
    """Rows whose step is over ratio times the recording's best score and whose fingerprint moved far enough."""
    out = with_baseline(profile, window).withColumn("_most", F.max("score").over(_video())).withColumn("_moved", hamming(F.lag("dhash").over(_line()), F.col("dhash")))
    threshold = (F.col("_most") * F.lit(ratio).cast("float")).cast("float")
    return out.filter((threshold > 0) & (F.col("step") > threshold) & (F.col("_moved") >= least_bits)).drop("_most", "_moved")


def scene_cuts(profile: DataFrame, window: int = 15, ratio: float = 0.5, least_bits: int = 16) -> DataFrame:
    """(video_id, idx) of scene changes: candidates at least `window` samples after the last accepted one.

    What fails the step or the fingerprint test never silences others, so both are tested before the fold.
    """
    return spaced(cut_candidates(profile, window, ratio, least_bits), "idx", window)


def sliced(profile: DataFrame, ranges: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Samples within each range (video_id, range_id, a, b), ends included and in either order; scores stay as they are."""
    rest = [c for c in ranges.columns if c not in ("video_id", "a", "b")]
    ordered = ranges.select("video_id", *rest, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return points_in_ranges(profile, ordered, bucket_ms)


def slice_duration(sliced_rows: DataFrame, fps: float) -> DataFrame:
    """(video_id, range_id, samples, duration_ms) of slices: last - first + one frame."""
    return sliced_rows.groupBy("video_id", "range_id").agg(F.count("*").alias("samples"), (F.max("t_ms") - F.min("t_ms") + round(1000 / fps)).alias("duration_ms"))


def strided(profile: DataFrame, fps: float, wanted_fps: float) -> DataFrame:
    """Every step-th sample, step = fps over the wanted rate (clamped to 1..fps), rounded, at least 1."""
    step = max(1, int(fps / min(max(wanted_fps, 1.0), max(fps, 1.0)) + 0.5))
    return profile.withColumn("_nth", F.row_number().over(_line()) - 1).filter(F.col("_nth") % step == 0).drop("_nth")


def totals(profile: DataFrame) -> DataFrame:
    """(video_id, samples, total, mean, peak, cuts) and, of a profile with cell_peak, cell_peak: the most that any cell of the
    picture moved."""
    score = F.col("score").cast("double")
    cells = [F.coalesce(F.max("cell_peak"), F.lit(0.0)).alias("cell_peak")] if "cell_peak" in profile.columns else []
    return profile.groupBy("video_id").agg(F.count("*").alias("samples"), F.sum(score).alias("total"), F.avg(score).alias("mean"), F.max(score).alias("peak"), F.count_if(F.col("is_scene_cut")).alias("cuts"), *cells)


def frame_difference(frames: DataFrame, value: Column) -> DataFrame:
    """frames with diff, the absolute change of a value since the previous sample (0 for the first)."""
    return frames.withColumn("diff", F.abs(F.coalesce(value - F.lag(value).over(_line()), F.lit(0.0))))
