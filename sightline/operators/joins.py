"""Range, nearest and priority joins. All carry the recording as an equality, so Spark never falls back to nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, bucket: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of strictly overlapping intervals (left: video_id, v_pos, v_start, v_end; right: h_pos, h_start, h_end).

    Both sides are listed in the time buckets that they touch, so a long recording is many join keys and not one; a pair
    counts in the first bucket that both touch.
    """

    def listed(df: DataFrame, a: str, b: str) -> DataFrame:
        # a long interval is listed once for each bucket: bucket should be near the usual length
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket))))

    wide = listed(left.withColumn("_a", F.col("v_start") - tolerance).withColumn("_b", F.col("v_end") + tolerance), "_a", "_b")
    pairs = wide.join(listed(right, "h_start", "h_end"), ["video_id", "_bucket"])
    pairs = pairs.filter("_a < h_end and h_start < _b").filter(F.col("_bucket") == F.greatest(F.floor(F.col("_a") / bucket), F.floor(F.col("h_start") / bucket)))
    return pairs.drop("_bucket", "_a", "_b")


def points_in_ranges(points: DataFrame, ranges: DataFrame, bucket: float, how: str = "inner") -> DataFrame:
    """points (video_id, t_ms, ...) with each range (video_id, a, b, ...) that holds their time, both ends included.

    A range is listed in the time buckets that it touches and a point in its own, so a long recording is many join keys.
    how may be left_semi, for points in any range.
    """
    low, high = F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket)
    listed = ranges.filter("a <= b").withColumn("_bucket", F.explode(F.sequence(low, high)))
    own = points.withColumn("_bucket", F.floor(F.col("t_ms") / bucket))
    at, of = own.alias("_at"), listed.alias("_of")
    met = (F.col("_at.video_id") == F.col("_of.video_id")) & (F.col("_at._bucket") == F.col("_of._bucket")) & F.col("_at.t_ms").between(F.col("_of.a"), F.col("_of.b"))
    out = at.join(of, met, how)
    rest = [] if how == "left_semi" else [F.col(f"_of.{c}") for c in ranges.columns if c not in points.columns]
    return out.select(*[F.col(f"_at.{c}") for c in points.columns], *rest)


def nearest(left: DataFrame, right: DataFrame, tolerance: int | None = None) -> DataFrame:
    """left (video_id, t_ms, ...) with the nearest right t_ms as n_t and its signed distance n_t - t_ms as n_off, null if none (within tolerance).

    Ties go to the earlier one. One ordered pass over both sides, without pairing them.
    """
    columns = left.columns
    own = left.select(*columns, F.lit(None).cast("long").alias("_r"))
    other = right.select("video_id", "t_ms").distinct().select(*[F.col(c) if c in ("video_id", "t_ms") else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns], F.col("t_ms").alias("_r"))
    line = Window.partitionBy("video_id").orderBy("t_ms")
    both = own.withColumn("_own", F.lit(True)).union(other.withColumn("_own", F.lit(False)))
    both = both.withColumn("_before", F.last("_r", ignorenulls=True).over(line.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.first("_r", ignorenulls=True).over(line.rangeBetween(0, Window.unboundedFollowing)))
    down, up = F.col("t_ms") - F.col("_before"), F.col("_after") - F.col("t_ms")
    picked = F.when(F.col("_after").isNull() | (down <= up), F.col("_before")).otherwise(F.col("_after"))
    out = both.filter("_own").withColumn("n_t", picked).withColumn("n_off", F.col("n_t") - F.col("t_ms"))
    if tolerance is not None:
        far = F.abs("n_off") > tolerance
        out = out.withColumn("n_t", F.when(~far, F.col("n_t"))).withColumn("n_off", F.when(~far, F.col("n_off")))
    return out.select(*columns, "n_t", "n_off")


def priority_match(left: DataFrame, by_key: Column, by_other: Column, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """left with value from first (key, value) or else from second (key, value): two equality joins, not one with or."""
    a, b = first.select(F.col("key").alias("_k1"), F.col(value).alias("_v1")), second.select(F.col("key").alias("_k2"), F.col(value).alias("_v2"))
    return left.join(a, by_key == F.col("_k1"), "left").join(b, by_other == F.col("_k2"), "left").withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """table with changes: the row with the highest version wins each key, changes before the table."""
    rank = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), *[F.col(v).desc() for v in version])
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_nth", F.row_number().over(rank)).filter("_nth = 1").drop("_nth", "_new")


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows behind its own; columns go by name and those that rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def cascade_deleted(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables without the rows of the deleted keys (one column, key), the owner's own table included."""
    gone = gone.select(key).distinct()
    return {name: table.join(gone, key, "left_anti") for name, table in tables.items()}


def display_names(rows: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """rows with name: the first of the sources (key, name) that knows the key, else # and the key."""
    out, found = rows, []
    for k, source in enumerate(sources):
        out = out.join(source.dropDuplicates([key]).select(F.col(key).alias(f"_k{k}"), F.col("name").alias(f"_n{k}")), F.col(key) == F.col(f"_k{k}"), "left")
        found.append(F.col(f"_n{k}"))
    return out.select(*rows.columns, F.coalesce(*found, F.concat(F.lit("#"), F.col(key).cast("string"))).alias("name"))


def inserted_if_new(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table with those rows whose key it lacks; of several new rows with one key the first comes in."""
    first = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))
