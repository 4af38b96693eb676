"""Quality metrics: coverage of truth by picks, matching, corpus roll-ups, repeated runs, classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.joins import nearest
from sightline.operators.sampling import Sampling, selected_frames, selection_statistics


def coverage(truth: DataFrame, picked: DataFrame, tolerance: int) -> DataFrame:
    """truth (video_id, t_ms) with miss, the distance to the nearest pick (null without picks), and whether it is within tolerance."""
    out = nearest(truth, picked).withColumn("miss", F.abs("n_off"))
    return out.withColumn("covered", F.coalesce(F.col("miss") <= tolerance, F.lit(False))).select("video_id", "t_ms", "miss", "covered")


def false_cuts(cuts: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """cuts (video_id, t_ms) with no truth within tolerance."""
    return nearest(cuts, truth, tolerance).filter("n_t is null").select("video_id", "t_ms")


def video_metrics(truth: DataFrame, picked: DataFrame, tolerance: int) -> DataFrame:
    """(video_id, total, covered, worst_miss, mean_offset): the mean over covered ones in whole milliseconds; nulls where there are none."""
    found = coverage(truth, picked, tolerance)
    return found.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(F.col("covered")).alias("covered"), F.max("miss").alias("worst_miss"), F.expr("sum(if(covered, miss, null)) div nullif(count_if(covered), 0)").alias("mean_offset"))


def selection_metrics(truth: DataFrame, profile: DataFrame, videos: DataFrame, how: Sampling, tolerance: int) -> DataFrame:
    """One row for each of videos (video_id, duration_ms, source_frames): how well the frames that `how` selects from a profile
    with dhash show the events of truth (video_id, t_ms), and what the selection costs.

    An event is covered by a frame within tolerance. worst_miss_ms is the farthest of those that are not, mean_offset_ms the
    whole mean of those that are (0 without any); reduction_ratio is source frames over selected ones. Gaps before near
    duplicates go may be as long as duration / sampled budget / alpha and five per cent more. False cuts are scene cuts
    without an event within tolerance. recall is null without events; a recording without frames has none selected.
    """
    selected = selected_frames(profile, how)
    stats = selection_statistics(selected, how)
    found = coverage(truth, selected.filter("kept"), tolerance).groupBy("video_id").agg(
        F.count("*").alias("events_total"), F.count_if("covered").alias("events_covered"), F.max(F.when(~F.col("covered"), F.col("miss"))).alias("worst_miss_ms"), F.expr("sum(if(covered, miss, null)) div nullif(count_if(covered), 0)").alias("mean_offset_ms")
    )
    cuts = profile.filter("is_scene_cut").select("video_id", "t_ms")
    cuts = nearest(cuts, truth, tolerance).groupBy("video_id").agg(F.count("*").alias("scene_cuts"), F.count_if(F.col("n_t").isNull()).alias("false_scene_cuts"))
    rows = videos.join(stats, "video_id", "left").join(found, "video_id", "left").join(cuts, "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    limit = F.round(F.col("duration_ms") / F.greatest(F.coalesce("sampled_budget", F.lit(how.budget)), F.lit(1)) / F.nullif(F.lit(float(how.alpha)), F.lit(0.0))).cast("long")
    return rows.select(
        "video_id", "duration_ms", zero("events_total"), zero("events_covered"), (F.col("events_covered") / F.nullif("events_total", F.lit(0))).alias("recall"), "worst_miss_ms", zero("mean_offset_ms"),
        F.coalesce("frames", F.lit(0)).alias("selected_frames"), zero("dropped_duplicates"), "source_frames", (F.col("source_frames") / F.greatest(F.coalesce("frames", F.lit(0)), F.lit(1))).alias("reduction_ratio"),
        zero("max_gap_ms"), zero("max_gap_before_dedup_ms"), limit.alias("gap_limit_ms"), F.coalesce(F.col("max_gap_before_dedup_ms") > limit * 1.05, F.lit(False)).alias("gap_violated"), zero("scene_cuts"), zero("false_scene_cuts"),
    )


def corpus_metrics(videos: DataFrame) -> DataFrame:
    """One row: micro recall (1 without events) and the unweighted mean of the videos' means, cut to whole milliseconds."""
    recall = F.coalesce(F.sum("covered") / F.nullif(F.sum("total"), F.lit(0)), F.lit(1.0))
    return videos.agg(F.count("*").alias("videos"), recall.alias("recall"), F.floor(F.avg(F.when(F.col("covered") > 0, F.col("mean_offset")))).cast("long").alias("mean_offset"))


def run_statistics(results: DataFrame) -> DataFrame:
    """(variant, runs, mean, low, high, spread, errors) of results (variant, run, matched, error): a failed item still counts as tried."""
    runs = results.groupBy("variant", "run").agg(F.sum(F.when(F.col("error"), 0).otherwise(F.col("matched"))).alias("matched"), F.count_if(F.col("error")).alias("errors"))
    return runs.groupBy("variant").agg(F.count("*").alias("runs"), F.avg("matched").alias("mean"), F.min("matched").alias("low"), F.max("matched").alias("high"), (F.max("matched") - F.min("matched")).alias("spread"), F.sum("errors").alias("errors"))


def run_comparison(results: DataFrame) -> DataFrame:
    """run_statistics() with what else tells variants apart: (variant, ..., results, produced, mean_offset_ms, mean_seconds, valid, without_actions).

    results are (variant, run, matched, error, produced, offsets_ms, seconds, valid, actions). A run's offset is the mean of
    the absolute values of all its offsets, its time that of its results without an error, both 0 where there are none; a
    variant's are the means of its runs'. produced is the mean number of events in a run.
    """
    sized = results.withColumn("_sum", F.aggregate(F.coalesce("offsets_ms", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + F.abs(x))).withColumn("_n", F.greatest(F.size("offsets_ms"), F.lit(0)))
    ok = ~F.col("error")
    mean = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    runs = sized.groupBy("variant", "run").agg(
        F.count("*").alias("results"), F.sum("produced").alias("produced"), mean(F.sum("_sum"), F.sum("_n")).alias("offset"), mean(F.sum(F.when(ok, F.col("seconds"))), F.count_if(ok)).alias("seconds"),
        F.count_if("valid").alias("valid"), F.count_if(F.col("actions") == 0).alias("without_actions"),
    )
    more = runs.groupBy("variant").agg(F.sum("results").alias("results"), F.avg("produced").alias("produced"), F.avg("offset").alias("mean_offset_ms"), F.avg("seconds").alias("mean_seconds"), F.sum("valid").alias("valid"), F.sum("without_actions").alias("without_actions"))
    return run_statistics(results).join(more, "variant")


def category_recall(rows: DataFrame, categories: list[str]) -> DataFrame:
    """(category, n, recall) for each of the categories: the share of rows (truth, predicted) of it that were predicted as it, 0
    where there are none."""
    wanted = rows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    found = rows.filter(F.col("truth").isin(*categories)).groupBy(F.col("truth").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("truth")).alias("right"))
    return wanted.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("right") / F.col("n"), F.lit(0.0)).alias("recall"))


def noise_band(stats: DataFrame, baseline: str) -> DataFrame:
    """stats with delta to the baseline variant and whether it is more than the widest spread of any variant."""
    one = stats.agg(F.max("spread").alias("band"), F.max(F.when(F.col("variant") == baseline, F.col("mean"))).alias("base"))
    return stats.crossJoin(F.broadcast(one)).select("variant", "band", (F.col("mean") - F.col("base")).alias("delta"), (F.abs(F.col("mean") - F.col("base")) > F.col("band")).alias("significant"))


def stability(results: DataFrame) -> DataFrame:
    """(name, stability): always_error, stable (one and the same value in all runs) or volatile; an error is a value of its own."""
    value = F.when(F.col("error"), F.lit(-1)).otherwise(F.col("matched"))
    per = results.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("error")).alias("errors"), F.min(value).alias("a"), F.max(value).alias("b"))
    return per.select("name", F.when(F.col("errors") == F.col("n"), "always_error").when(F.col("a") == F.col("b"), "stable").otherwise("volatile").alias("stability"))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """One row of recall, false positive rate and accuracy of rows (truth, predicted: 0 or 1); 0 where there is nothing to divide by."""
    n = lambda cond: F.count_if(cond)
    t, p = F.col("truth") == 1, F.col("predicted") == 1
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), ratio(n(t & p), n(t)).alias("recall"), ratio(n(~t & p), n(~t)).alias("fpr"), ratio(n(t == p), F.count("*")).alias("accuracy"))
