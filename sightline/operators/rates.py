"""Rates of counters over sliding windows, shares of them, sums of gauges and quantiles of cumulative buckets.

Samples are (keys..., t, value) with t in seconds; a series is one combination of the keys. A counter that falls was reset and
began again at 0. A rate follows the usual rule of metric stores: the increase between a window's first and last sample,
carried on to the window's ends where the samples come near enough to them, over the window's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rates(samples: DataFrame, keys: list[str], window: float, step: float) -> DataFrame:
    """(keys..., at, rate) at each multiple of step with at least two samples within the window before it (its start left out).

    The increase is carried on to an end of the window that is less than 1.1 mean distances away, else by half a mean
    distance, and at the start no further than to where the counter would be 0. A sample is listed once for each window that
    holds it (window over step times), so a long series is many groups.
    """
    line = Window.partitionBy(*keys).orderBy("t")
    rows = samples.withColumn("_before", F.lag("value").over(line)).withColumn("_t", F.lag("t").over(line))
    rows = rows.withColumn("_gain", F.when(F.col("value") < F.col("_before"), F.col("value")).otherwise(F.col("value") - F.col("_before")))
    first, last = F.ceil(F.col("t") / step), F.ceil((F.col("t") + window) / step) - 1
    rows = rows.filter(first <= last).withColumn("_nth", F.explode(F.sequence(first, last))).withColumn("at", F.col("_nth") * F.lit(float(step)))
    inside = F.when(F.col("_t") > F.col("at") - window, F.col("_gain"))
    out = rows.groupBy(*keys, "at").agg(F.count("*").alias("_n"), F.min("t").alias("_first"), F.max("t").alias("_last"), F.min_by("value", "t").alias("_value"), F.sum(inside).alias("_gain"))
    out = out.filter("_n > 1 and _last > _first").withColumn("_span", F.col("_last") - F.col("_first")).withColumn("_mean", F.col("_span") / (F.col("_n") - 1))
    carried = lambda gap: F.when(gap < 1.1 * F.col("_mean"), gap).otherwise(F.col("_mean") / 2)
    start = F.col("_first") - (F.col("at") - window)
    zero = F.when((F.col("_gain") > 0) & (F.col("_value") >= 0), F.col("_span") * F.col("_value") / F.col("_gain"))
    factor = (F.col("_span") + carried(F.least(start, F.coalesce(zero, start))) + carried(F.col("at") - F.col("_last"))) / F.col("_span")
    return out.select(*keys, "at", (F.col("_gain") * factor / window).alias("rate"))


def error_share(found: DataFrame, by: list[str], is_error) -> DataFrame:
    """(by..., at, rate, percent) of rates(): the sum over all series, and what per cent of it the errors have; null without any."""
    out = found.groupBy(*by, "at").agg(F.sum("rate").alias("rate"), F.coalesce(F.sum(F.when(is_error, F.col("rate"))), F.lit(0.0)).alias("_bad"))
    return out.select(*by, "at", "rate", (F.col("_bad") / F.nullif("rate", F.lit(0.0)) * 100).alias("percent"))


def gauge_sums(samples: DataFrame, keys: list[str], by: list[str], step: float, stale: float) -> DataFrame:
    """(by..., at, value): the sum over the series of by of the last sample at or before each multiple of step, if it is less than
    `stale` seconds old."""
    first, last = F.ceil(F.col("t") / step), F.ceil((F.col("t") + stale) / step) - 1
    rows = samples.filter(first <= last).withColumn("_nth", F.explode(F.sequence(first, last))).withColumn("at", F.col("_nth") * F.lit(float(step)))
    newest = rows.groupBy(*keys, "at").agg(F.max_by("value", "t").alias("value"))
    return newest.groupBy(*by, "at").agg(F.sum("value").alias("value"))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by..., value) from cumulative buckets (by..., le, count), le a number or +infinity: linear within the bucket that holds the
    quantile. In the last bucket it is the bound before, in a first one that ends at 0 or below its end; null where the buckets
    lack +infinity or hold nothing, or where there is one alone."""
    line = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    # a bucket never holds less than those below it
    rows = buckets.withColumn("count", F.max("count").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_total", F.max(F.when(F.col("le") == float("inf"), F.col("count"))).over(whole)).withColumn("_buckets", F.count("*").over(whole))
    rows = rows.withColumn("_low", F.lag("le").over(line)).withColumn("_below", F.coalesce(F.lag("count").over(line), F.lit(0.0))).withColumn("_rank", q * F.col("_total"))
    hit = (F.col("count") >= F.col("_rank")) & (F.col("_total") > 0) & (F.col("_buckets") > 1)
    low = F.coalesce("_low", F.lit(0.0))
    inside = low + (F.col("le") - low) * (F.col("_rank") - F.col("_below")) / F.nullif(F.col("count") - F.col("_below"), F.lit(0.0))
    value = F.when(F.col("le") == float("inf"), F.col("_low")).when(F.col("_low").isNull() & (F.col("le") <= 0), F.col("le")).otherwise(F.coalesce(inside, low))
    return rows.groupBy(*by).agg(F.min_by(F.when(hit, value), F.when(hit, F.col("le"))).alias("value"))
