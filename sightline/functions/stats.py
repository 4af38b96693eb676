"""Order statistics with the exact rank rules that the profile and sampling operators need.

Spark's percentile functions interpolate or round ranks differently for even counts, so the ranks are spelled out here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank_index(n: Column, p: float) -> Column:
    """0-based rank floor((n - 1) * p + 0.5): the nearest rank, half up."""
    return F.floor((n - 1) * F.lit(p) + F.lit(0.5)).cast("int")


def floor_rank_index(n: Column, p: float) -> Column:
    """0-based rank floor(n * p), at most n - 1."""
    return F.least(F.floor(n * F.lit(p)).cast("int"), (n - 1).cast("int"))


def at_rank(values: Column, p: float = 0.5) -> Column:
    """The nearest-rank value of an array (at 0.5 the upper median); null for an empty one."""
    return F.get(F.array_sort(values), nearest_rank_index(F.size(values), p))


def with_nearest_rank(df: DataFrame, keys: list[str], value: str, p: float, name: str, order: str | None = None) -> DataFrame:
    """df with each group's nearest-rank value of a column.

    The rank is picked from a sorted window, which spills, rather than from a group's values gathered in memory.
    """
    whole = Window.partitionBy(*keys)
    ranked = df.withColumn("_n", F.count(value).over(whole)).withColumn("_at", F.row_number().over(whole.orderBy(F.col(value).asc_nulls_last(), *([order] if order else []))) - 1)
    picked = F.max(F.when(F.col("_at") == nearest_rank_index(F.col("_n"), p), F.col(value))).over(whole)
    return ranked.withColumn(name, picked).drop("_n", "_at")
