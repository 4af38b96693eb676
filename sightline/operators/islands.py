"""Gaps and islands over ordered rows: runs, merged intervals, clusters. All are windows on one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def island_ids(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str) -> DataFrame:
    """df numbered by islands (1, 2, ...): a new one begins wherever breaks is true or null."""
    line = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def hysteresis_runs(scores: DataFrame, keys: list[str], threshold: float, release: float) -> DataFrame:
    """(keys, run, start_w, end_w, peak, peak_w, total, n): runs that open at threshold and last while the score is release or more.

    Groups that never reach the threshold are left out before anything is sorted. Needs release <= threshold.
    """
    line = Window.partitionBy(*keys).orderBy("w")
    score = F.col("score").cast("double")
    live = scores.withColumn("_top", F.max(score).over(Window.partitionBy(*keys))).filter(F.col("_top") >= threshold)
    signal = F.when(score >= threshold, 1).when(score < release, 0)
    state = F.coalesce(F.last(signal, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    live = live.withColumn("_on", state).filter(F.col("_on").isNotNull())
    rising = (F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(line), F.lit(0)) == 0)
    live = live.withColumn("_rise", F.when(rising, 1).otherwise(0)).withColumn("run", F.sum("_rise").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by("w", F.struct(F.col("score"), -F.col("w")))
    return live.filter("_on = 1").groupBy(*keys, "run").agg(F.min("w").alias("start_w"), F.max("w").alias("end_w"), F.max(score).alias("peak"), best.alias("peak_w"), F.sum(score).alias("total"), F.count("*").alias("n"))


def gap_merged(runs: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Runs with at most `gap` windows between them as one; its peak is the first of the highest."""
    line = Window.partitionBy(*keys).orderBy("start_w")
    marked = island_ids(runs.withColumn("_gap", F.col("start_w") - F.lag("end_w").over(line) - 1), keys, ["start_w"], F.col("_gap") > gap, "run")
    best = F.max_by("peak_w", F.struct(F.col("peak"), -F.col("start_w")))
    return marked.groupBy(*keys, "run").agg(F.min("start_w").alias("start_w"), F.max("end_w").alias("end_w"), F.max("peak").alias("peak"), best.alias("peak_w"), F.sum("total").alias("total"), F.sum("n").alias("n"))


def merged_ids(df: DataFrame, keys: list[str], order: list[str], slack: float, name: str, touching: bool = True) -> DataFrame:
    """Intervals (start, end) numbered by what they merge to: start <= the running largest end + slack (start < it unless touching)."""
    line = Window.partitionBy(*keys).orderBy(*order)
    before = df.withColumn("_reach", F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    limit = F.col("_reach") + slack
    breaks = F.col("start") > limit if touching else F.col("start") >= limit
    return island_ids(before, keys, order, breaks, name).drop("_reach")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Consecutive equal values numbered as one run; nulls break runs."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return island_ids(df.withColumn("_before", F.lag(value).over(line)), keys, order, F.col(value).isNull() | F.col("_before").isNull() | (F.col(value) != F.col("_before")), name).drop("_before")


def mode_smoothed(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with the value replaced by its two neighbours' where they agree with each other and not with it."""
    line = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(value).over(line), F.lead(value).over(line)
    return df.withColumn("smoothed", F.when((before == after) & (F.col(value) != before), before).otherwise(F.col(value)))
