"""Budgeted frame sampling: mixture weights, inverse-CDF picks, a quota for scene cuts, gap statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.stats import with_nearest_rank
from sightline.operators.folds import near_duplicates_marked, near_duplicates_removed


def _video():
    return Window.partitionBy("video_id")


def _line():
    return _video().orderBy("idx")


def weighted(profile: DataFrame, alpha: float, subtract_floor: bool = True) -> DataFrame:
    """profile with eff (motion over the noise floor), weight and cum (weights up to and with the row).

    weight = (1 - alpha) * eff / sum + alpha / n; the first part is 0 where a recording has no motion.
    """
    score = profile.withColumn("_s", F.col("score").cast("double"))
    score = with_nearest_rank(score, ["video_id"], "_s", 0.5, "_floor", "idx") if subtract_floor else score.withColumn("_floor", F.lit(0.0))
    out = score.withColumn("eff", F.greatest(F.col("_s") - F.col("_floor"), F.lit(0.0)))
    out = out.withColumn("_sum", F.sum("eff").over(_video())).withColumn("_n", F.count("*").over(_video()))
    motion = F.when(F.col("_sum") > 0, (1 - alpha) * (F.col("eff") / F.nullif(F.col("_sum"), F.lit(0.0)))).otherwise(F.lit(0.0))
    out = out.withColumn("weight", motion + alpha / F.col("_n"))
    return out.withColumn("cum", F.sum("weight").over(_line().rowsBetween(Window.unboundedPreceding, 0))).drop("_s", "_floor", "_sum", "_n")


def inverse_cdf_picks(weights: DataFrame, targets: DataFrame) -> DataFrame:
    """(video_id, j, idx) for targets (video_id, n_targets): target j = (j + 0.5) / n_targets of the total weight falls on the first row whose cum reaches it.

    Which targets a row meets follows from its share of the total, so targets and rows are not paired; the last row's range
    has no end, so every target meets exactly one row.
    """
    last = F.lead("cum").over(_line()).isNull()
    rows = weights.withColumn("_low", F.coalesce(F.lag("cum").over(_line()), F.lit(float("-inf")))).withColumn("_high", F.when(last, F.lit(float("inf"))).otherwise(F.col("cum"))).withColumn("_total", F.max("cum").over(_video()))
    rows = rows.select("video_id", "idx", "_low", "_high", "_total")
    met = rows.join(targets.filter("n_targets > 0").select("video_id", "n_targets"), "video_id")
    n, share = F.col("n_targets"), lambda c: F.coalesce(F.try_divide(F.col(c), F.col("_total")), F.lit(0.0)) * F.col("n_targets") - 0.5
    # one more on either side, because the shares are rounded; the exact test follows
    first = F.when(F.col("_low") < 0, 0).otherwise(F.greatest(F.floor(share("_low")) - 1, F.lit(0)))
    last_one = F.when(F.col("_high") == float("inf"), n - 1).otherwise(F.least(F.ceil(share("_high")) + 1, n - 1))
    met = met.withColumn("_first", first.cast("int")).withColumn("_last", last_one.cast("int")).filter("_first <= _last")
    met = met.withColumn("j", F.explode(F.sequence("_first", "_last"))).withColumn("_target", (F.col("j") + 0.5) / n * F.col("_total"))
    return met.filter("_low < _target and _target <= _high").select("video_id", F.col("j").cast("long").alias("j"), "idx")


def quota_cuts(profile: DataFrame, budget: int) -> DataFrame:
    """(video_id, idx): at most max(1, budget / 2) scene cuts a recording, the strongest first, the earlier on ties."""
    quota = max(1, budget // 2)
    rank = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "idx")
    return profile.filter("is_scene_cut").withColumn("_nth", F.row_number().over(rank)).filter(F.col("_nth") <= quota).select("video_id", "idx")


def marked_frames(profile: DataFrame, budget: int, alpha: float, subtract_floor: bool = True) -> DataFrame:
    """weighted() with reason: scene_cut for cuts within their quota (see quota_cuts()), motion for what the targets left by
    the budget fall on (see inverse_cdf_picks()), null for all others. Everything is worked out beside the rows of a
    recording, in one partitioning."""
    quota = max(1, budget // 2)
    strongest = _video().orderBy(F.col("is_scene_cut").desc(), F.col("score").desc(), "idx")
    rows = weighted(profile, alpha, subtract_floor)
    rows = rows.withColumn("_forced", F.coalesce(F.col("is_scene_cut"), F.lit(False)) & (F.row_number().over(strongest) <= quota))
    rows = rows.withColumn("_n", F.lit(budget) - F.count_if("_forced").over(_video())).withColumn("_total", F.max("cum").over(_video()))
    rows = rows.withColumn("_low", F.coalesce(F.lag("cum").over(_line()), F.lit(float("-inf")))).withColumn("_high", F.when(F.lead("cum").over(_line()).isNull(), F.lit(float("inf"))).otherwise(F.col("cum")))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("_total")), F.lit(0.0)) * F.col("_n") - 0.5
    # one more on either side, because the shares are rounded; the exact test follows
    first = F.when(F.col("_low") < 0, 0).otherwise(F.greatest(F.floor(share("_low")) - 1, F.lit(0)))
    last = F.when(F.col("_high") == float("inf"), F.col("_n") - 1).otherwise(F.least(F.ceil(share("_high")) + 1, F.col("_n") - 1))
    reaches = lambda j: (F.col("_low") < (j + 0.5) / F.col("_n") * F.col("_total")) & ((j + 0.5) / F.col("_n") * F.col("_total") <= F.col("_high"))
    met = (F.col("_n") > 0) & (first <= last) & F.exists(F.sequence(F.least(first, last).cast("int"), last.cast("int")), reaches)
    reason = F.when(F.col("_forced"), "scene_cut").when(met, "motion")
    return rows.withColumn("reason", reason).drop("_forced", "_n", "_total", "_low", "_high")


def chosen_frames(profile: DataFrame, budget: int, alpha: float, subtract_floor: bool = True) -> DataFrame:
    """(video_id, idx, reason): cuts within their quota, then motion picks for what the budget leaves; a row picked twice counts once."""
    return marked_frames(profile, budget, alpha, subtract_floor).filter("reason is not null").select("video_id", "idx", "reason")


#: Share of a step's motion (all motion over the budget) within which nothing has happened between two frames.
MOTION_TOLERANCE = 0.1


def _with_motion(profile: DataFrame, budget: int, alpha: float, subtract_floor: bool = True) -> DataFrame:
    """The chosen rows of marked_frames() with what the search for near duplicates needs."""
    rows = marked_frames(profile, budget, alpha, subtract_floor)
    rows = rows.withColumn("own", F.col("eff")).withColumn("tolerance", F.sum("eff").over(_video()) / budget * MOTION_TOLERANCE)
    rows = rows.withColumn("cum", F.sum("eff").over(_line().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("reason is not null").withColumn("forced", F.col("reason") == "scene_cut")


def chosen_without_near_duplicates(profile: DataFrame, budget: int, alpha: float, bits: int) -> DataFrame:
    """(video_id, idx) of chosen_frames() without near duplicates; profile has dhash. Scene cuts always stay."""
    return near_duplicates_removed(_with_motion(profile, budget, alpha), bits).select("video_id", "idx")


@dataclass(frozen=True)
class Sampling:
    """How frames are chosen: how many at most, the share that is spread evenly, the bits within which two frames look alike
    (0: none do), whether the noise floor is taken off and whether scene cuts are forced."""

    budget: int = 16
    alpha: float = 0.25
    bits: int = 3
    subtract_floor: bool = True
    force_cuts: bool = True

    def check(self) -> None:
        if self.budget <= 0:
            raise ValueError("the budget must be above 0")
        if not 0.0 <= self.alpha <= 1.0:
            raise ValueError("alpha must be from 0 to 1")


def selected_frames(profile: DataFrame, how: Sampling) -> DataFrame:
    """(video_id, idx, t_ms, score, is_scene_cut, reason, kept) of the frames that a budget chooses from each recording of a
    profile with dhash; kept is false for near duplicates."""
    how.check()
    source = profile if how.force_cuts else profile.withColumn("is_scene_cut", F.lit(False))
    rows = _with_motion(source, how.budget, how.alpha, how.subtract_floor)
    return near_duplicates_marked(rows, how.bits, ["t_ms", "score", "is_scene_cut", "reason"]).select("video_id", "idx", "t_ms", "score", "is_scene_cut", "reason", "kept")


def selection_statistics(selected: DataFrame, how: Sampling) -> DataFrame:
    """(video_id, budget, sampled_budget, frames, cuts, dropped_duplicates, max_gap_before_dedup_ms, max_gap_ms, mean_gap_ms) of
    selected_frames(). sampled_budget is what the forced cuts leave to be sampled by motion."""
    line = Window.partitionBy("video_id").orderBy("t_ms")
    last_kept = F.last(F.when(F.col("kept"), F.col("t_ms")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = selected.withColumn("_all", F.col("t_ms") - F.lag("t_ms").over(line)).withColumn("_own", F.when(F.col("kept"), F.col("t_ms") - last_kept))
    cuts, most = F.count_if(F.col("reason") == "scene_cut"), lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    mean = F.coalesce(F.expr("sum(_own) div nullif(count(_own), 0)"), F.lit(0)).cast("long")
    budget = F.lit(how.budget).cast("long")
    return rows.groupBy("video_id").agg(budget.alias("budget"), (budget - cuts).alias("sampled_budget"), F.count_if("kept").alias("frames"), cuts.alias("cuts"), F.count_if(~F.col("kept")).alias("dropped_duplicates"), most("_all").alias("max_gap_before_dedup_ms"), most("_own").alias("max_gap_ms"), mean.alias("mean_gap_ms"))


def gap_statistics(frames: DataFrame) -> DataFrame:
    """(video_id, frames, max_gap_ms, mean_gap_ms) of chosen times; the mean is cut to whole milliseconds, both are 0 below two frames."""
    gaps = frames.withColumn("_gap", F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy("video_id").orderBy("t_ms")))
    return gaps.groupBy("video_id").agg(F.count("*").alias("frames"), F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("max_gap_ms"), F.coalesce(F.expr("sum(_gap) div nullif(count(_gap), 0)"), F.lit(0)).cast("long").alias("mean_gap_ms"))
