"""The seven named tools as functions over DataFrames, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.clock import slow_motion
from sightline.operators import joins, profile, sampling


def video_info(videos: DataFrame) -> DataFrame:
    return videos.select("video_id", "duration_ms", "fps", "width", "height", "codec")


def motion_profile(frames: DataFrame, bucket_ms: int = 1000) -> DataFrame:
    rows = profile.normalised(frames).withColumn("is_scene_cut", F.lit(False))
    return profile.bucketed(rows, bucket_ms)


def sample_overview(rows: DataFrame, budget: int = 16, alpha: float = 0.25) -> DataFrame:
    return sampling.chosen_frames(rows, budget, alpha)


def zoom_range(rows: DataFrame, ranges: DataFrame, budget: int = 8, alpha: float = 0.25) -> DataFrame:
    """Frames chosen within each range (video_id, range_id, a, b) from the whole recording's scores: (video_id, range_id, idx, reason)."""
    cut = profile.sliced(rows, ranges).withColumn("_key", F.concat_ws("/", F.col("video_id").cast("string"), F.col("range_id").cast("string")))
    keys = cut.select("_key", "video_id", "range_id").distinct()
    chosen = sampling.chosen_frames(cut.drop("video_id").withColumnRenamed("_key", "video_id"), budget, alpha).withColumnRenamed("video_id", "_key")
    return chosen.join(keys, "_key").select("video_id", "range_id", "idx", "reason")


def get_frame(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sample nearest to each wanted time (video_id, t_ms)."""
    return joins.nearest(wanted, rows).select("video_id", "t_ms", F.col("n_t").alias("frame_ms"))


def crop_region(frames: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Pixel bounds (left, top, right, bottom) of a crop given in shares of the frame, kept inside it."""
    x, y = min(max(x, 0.0), 0.99), min(max(y, 0.0), 0.99)
    w, h = min(max(w, 0.01), 1 - x), min(max(h, 0.01), 1 - y)
    bound = lambda side, share: F.round(F.col(side) * share).cast("int")
    return frames.select("video_id", "idx", bound("width", x).alias("left"), bound("height", y).alias("top"), bound("width", x + w).alias("right"), bound("height", y + h).alias("bottom"))


def clip_range(ranges: DataFrame, frames_wanted: int = 32) -> DataFrame:
    """Clips (video_id, t0, t1) with how far they are stretched, the frames a service sees at 2 a second, and its rate."""
    ms = F.col("t1") - F.col("t0")
    out = ranges.filter("t1 > t0").withColumn("time_scale", slow_motion(F.lit(frames_wanted), ms))
    return out.withColumn("service_frames", F.round(ms / 1000 * F.col("time_scale") * 2).cast("long")).withColumn("effective_fps", 2 * F.col("time_scale"))


TOOLS = {f.__name__: f for f in (video_info, motion_profile, sample_overview, zoom_range, get_frame, crop_region, clip_range)}
