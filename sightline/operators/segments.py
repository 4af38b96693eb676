"""Scores to interval events: segmentation, class summaries, priority caps, windows and chunk plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.islands import gap_merged, hysteresis_runs


def segmented(scores: DataFrame, keys: list[str], threshold: float, release: float, gap_windows: int, window_sec: float, hop_sec: float, min_sec: float, duration: str | None = None) -> DataFrame:
    """(keys, start_sec, end_sec, peak_sec, confidence, mean_confidence): events of each class, ends and peaks clamped to the duration column if given."""
    runs = gap_merged(hysteresis_runs(scores, keys, threshold, release), keys, gap_windows)
    end, peak = F.col("end_w") * hop_sec + window_sec, F.col("peak_w") * hop_sec + window_sec / 2
    if duration:
        # durations are one row a recording
        runs = runs.join(scores.groupBy(*keys).agg(F.max(duration).alias("_duration")), keys)
        end, peak = F.least(end, F.col("_duration")), F.least(peak, F.col("_duration"))
    out = runs.select(*keys, (F.col("start_w") * hop_sec).alias("start_sec"), end.alias("end_sec"), peak.alias("peak_sec"), F.col("peak").alias("confidence"), (F.col("total") / F.col("n")).alias("mean_confidence"))
    return out.filter(F.col("end_sec") - F.col("start_sec") >= min_sec)


def class_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("total_sec"), F.count("*").alias("event_count"), F.max("confidence").alias("peak_confidence"))


def ordered_summary(summary: DataFrame, key: str) -> DataFrame:
    """class_summary() rows with nth, their number in a recording by total length, the longest first, then by class."""
    rank = Window.partitionBy("video_id").orderBy(F.col("total_sec").desc(), key)
    return summary.withColumn("nth", F.row_number().over(rank).cast("long"))


def capped(events: DataFrame, most: int, order: list[str]) -> DataFrame:
    """At most `most` events a recording, those with is_safety first, then by confidence; truncated says whether any went, and
    place numbers the kept ones by start (where events have one), at one start the more confident first."""
    rank = Window.partitionBy("video_id").orderBy(F.col("is_safety").desc(), F.col("confidence").desc(), *order)
    out = events.withColumn("_nth", F.row_number().over(rank)).withColumn("truncated", F.count("*").over(Window.partitionBy("video_id")) > most)
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(*[c for c in events.columns if c == "start"], F.col("confidence").desc(), *order))
    return out.filter(F.col("_nth") <= most).withColumn("place", place.cast("long")).drop("_nth")


def picked_class(scores: DataFrame, threshold: float, alerts: list[str]) -> DataFrame:
    """(video_id, w, cls): a window's best class of at least the threshold, an alert class before all others; ties go by name."""
    rows = scores.filter(F.col("score").cast("double") >= threshold)
    return rows.groupBy("video_id", "w").agg(F.min_by("class", F.struct(~F.col("class").isin(*alerts), -F.col("score"), "class")).alias("cls"))


def top_classes(scores: DataFrame, k: int) -> DataFrame:
    """(video_id, w, rank, class, score): the k best classes of each window, scores with three decimals, ties by class."""
    rank = Window.partitionBy("video_id", "w").orderBy(F.col("score").desc(), "class")
    out = scores.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return out.select("video_id", "w", F.col("rank").cast("long").alias("rank"), "class", F.round(F.col("score").cast("double"), 3).alias("score"))


def sliding_windows(videos: DataFrame, window: int, hop: int) -> DataFrame:
    """(video_id, w, first, last): windows of n_frames frames from the first frame on; 1 if they fit in one, else ceil((n - window) / hop) + 1."""
    n = F.when(F.col("n_frames") <= window, F.lit(1)).otherwise(F.ceil((F.col("n_frames") - window) / hop) + 1)
    out = videos.filter("n_frames > 0").select("video_id", "n_frames", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("w"))
    return out.select("video_id", F.col("w").cast("long").alias("w"), (F.col("w") * hop).cast("long").alias("first"), F.least(F.col("w") * hop + window, F.col("n_frames")).cast("long").alias("last"))


def segment_plan(videos: DataFrame, most_ms: int, overlap_ms: int) -> DataFrame:
    """(video_id, seq, t0, t1): overlapping pieces of each duration_ms; one if it fits, the last ends with the recording."""
    step = max(1, most_ms - overlap_ms)
    n = F.when(F.col("duration_ms") <= most_ms, F.lit(1)).otherwise(F.ceil((F.col("duration_ms") - most_ms) / step) + 1)
    out = videos.filter("duration_ms > 0").select("video_id", "duration_ms", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("seq"))
    return out.select("video_id", F.col("seq").cast("long").alias("seq"), (F.col("seq") * F.lit(step).cast("long")).alias("t0"), F.least(F.col("seq") * F.lit(step).cast("long") + most_ms, F.col("duration_ms")).alias("t1"))


def chunk_overlaps(plan: DataFrame) -> DataFrame:
    """(video_id, a, b): where neighbouring pieces overlap."""
    line = Window.partitionBy("video_id").orderBy("seq")
    return plan.withColumn("_next", F.lead("t0").over(line)).filter("_next < t1").select("video_id", F.col("_next").alias("a"), F.col("t1").alias("b"))
