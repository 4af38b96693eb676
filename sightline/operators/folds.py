"""Ordered greedy selections whose next step depends on what was accepted last.

They have no window form. Each runs as one fold over a recording's candidates, which the callers have thinned out before;
the fold's array is one recording's candidates, not its samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(df: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"))


def spaced(df: DataFrame, value: str, least: int, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """(keys, value): in order, those at least `least` after the last accepted one."""
    kind = df.schema[value].dataType.simpleString()
    start = F.expr(f"cast(array() as array<{kind}>)")

    def step(kept: Column, row: Column) -> Column:
        fits = (F.size(kept) == 0) | (row[value] - F.element_at(kept, -1) >= least)
        return F.when(fits, F.concat(kept, F.array(row[value]))).otherwise(kept)

    return _ordered(df, list(keys), value).select(*keys, F.explode(F.aggregate("_rows", start, step)).alias(value))


def chunk_deduplicated(df: DataFrame, gap: int) -> DataFrame:
    """(video_id, t_ms, pos): events in order of time, then pos; one inside an overlap of chunks (in_overlap) goes if the last kept is within gap."""
    start = F.expr("cast(array() as array<struct<t_ms:bigint,pos:bigint>>)")

    def step(kept: Column, row: Column) -> Column:
        again = row["in_overlap"] & (F.size(kept) > 0) & (row["t_ms"] - F.element_at(kept, -1)["t_ms"] <= gap)
        own = F.struct(row["t_ms"].cast("long").alias("t_ms"), row["pos"].cast("long").alias("pos"))
        return F.when(again, kept).otherwise(F.concat(kept, F.array(own)))

    rows = _ordered(df, ["video_id"], "t_ms", "pos", "in_overlap")
    return rows.select("video_id", F.explode(F.aggregate("_rows", start, step)).alias("e")).select("video_id", "e.t_ms", "e.pos")


def first_starts(df: DataFrame, near: float = 1.0) -> DataFrame:
    """Pairs (video_id, v_pos, h_pos, start, ...) in order of v_pos and h_pos; one goes if any kept one starts within `near` of it."""
    rest = [c for c in df.columns if c not in ("video_id", "v_pos", "h_pos")]
    kind = df.select("v_pos", "h_pos", *rest).schema.simpleString()
    start = F.expr(f"cast(array() as array<{kind}>)")

    def step(kept: Column, row: Column) -> Column:
        again = F.exists(kept, lambda k: F.abs(k["start"] - row["start"]) < near)
        return F.when(again, kept).otherwise(F.concat(kept, F.array(row)))

    rows = _ordered(df, ["video_id"], "v_pos", "h_pos", *rest)
    return rows.select("video_id", F.explode(F.aggregate("_rows", start, step)).alias("e")).select("video_id", "e.*")


def near_duplicates_marked(df: DataFrame, bits: int, carried: list[str], tolerance: Column | None = None) -> DataFrame:
    """(video_id, idx, forced, kept and the carried columns) of candidates (video_id, idx, dhash, cum, own, forced, tolerance).

    In order of idx, those are kept that have no kept one within `bits` of Hamming distance and with no more than the
    recording's tolerance of motion between; forced ones always are. cum is the motion up to and with the sample, own the
    sample's.
    """
    fields = ["idx", "dhash", "cum", "own", "forced", "tolerance", *carried]
    rows = df.select("video_id", F.col("idx").cast("long").alias("idx"), "dhash", F.col("cum").cast("double").alias("cum"), F.col("own").cast("double").alias("own"), "forced", (F.col("tolerance") if tolerance is None else tolerance).cast("double").alias("tolerance"), *carried)
    out = rows.select(*fields).withColumn("kept", F.lit(True))
    start = F.expr(f"cast(array() as array<{out.schema.simpleString()}>)")

    def step(done: Column, row: Column) -> Column:
        same = F.exists(done, lambda k: k["kept"] & (F.bit_count(k["dhash"].bitwiseXOR(row["dhash"])) <= bits) & (row["cum"] - k["cum"] + k["own"] <= row["tolerance"]))
        kept = ~F.coalesce(same, F.lit(False)) | row["forced"] | F.lit(bits <= 0)
        return F.concat(done, F.array(row.withField("kept", kept)))

    rows = _ordered(rows, ["video_id"], *fields)
    return rows.select("video_id", F.explode(F.aggregate("_rows", start, step)).alias("e")).select("video_id", "e.idx", "e.forced", "e.kept", *[f"e.{c}" for c in carried])


def near_duplicates_removed(df: DataFrame, bits: int, tolerance: Column | None = None) -> DataFrame:
    """(video_id, idx, forced) of those that near_duplicates_marked() keeps."""
    return near_duplicates_marked(df, bits, [], tolerance).filter("kept").select("video_id", "idx", "forced")
