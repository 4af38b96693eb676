"""Made-up recordings with known events: segments of still, moving and changed scenes as motion profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (name, segments of (scene, seconds)); an event is expected where the scene changes.
SCENARIOS = (
    ("quiet", (("still", 20),)),
    ("one change", (("still", 8), ("pattern", 8))),
    ("burst", (("still", 12), ("moving", 3), ("still", 10))),
    ("two bursts", (("still", 6), ("moving", 2), ("still", 6), ("moving", 2), ("still", 6))),
    ("long motion", (("moving", 20),)),
    ("scenes", (("still", 5), ("pattern", 5), ("other", 5), ("pattern", 5))),
)
LEVEL = {"still": 0.02, "pattern": 0.05, "other": 0.05, "moving": 0.6}
MARK = {"still": 0, "pattern": (1 << 40) - 1, "other": ((1 << 62) - 1) ^ ((1 << 20) - 1), "moving": (1 << 10) - 1}


def segments(spark: SparkSession, scenarios=SCENARIOS) -> DataFrame:
    """(video_id, name, seq, scene, seconds)."""
    rows = [(v, name, k, scene, float(s)) for v, (name, parts) in enumerate(scenarios) for k, (scene, s) in enumerate(parts)]
    return spark.createDataFrame(rows, "video_id long, name string, seq long, scene string, seconds double")


def expected_events(parts: DataFrame) -> DataFrame:
    """(video_id, t_ms): the start of each segment whose scene differs from the one before."""
    line = Window.partitionBy("video_id").orderBy("seq")
    rows = parts.withColumn("_before", F.lag("scene").over(line)).withColumn("_at", F.sum("seconds").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("seconds"))
    return rows.filter("_before is not null and _before <> scene").select("video_id", F.round(F.col("_at") * 1000).cast("long").alias("t_ms"))


def motion(parts: DataFrame, fps: float = 15.0) -> DataFrame:
    """(video_id, idx, t_ms, raw, dhash): frames of each segment; the first one of a changed scene moves most."""
    line = Window.partitionBy("video_id").orderBy("seq")
    level = F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv])
    mark = F.create_map(*[x for k, v in MARK.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    frames = F.round(F.col("seconds") * fps).cast("int")
    rows = parts.withColumn("_n", frames).withColumn("_first", F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_before", F.lag("scene").over(line))
    rows = rows.filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    changed = (F.col("_k") == 0) & F.col("_before").isNotNull() & (F.col("_before") != F.col("scene"))
    rows = rows.withColumn("idx", (F.col("_first") + F.col("_k")).cast("long")).withColumn("raw", F.when(changed, 1.0).otherwise(level[F.col("scene")]))
    return rows.select("video_id", "idx", F.round(F.col("idx") * 1000 / fps).cast("long").alias("t_ms"), "raw", mark[F.col("scene")].alias("dhash"))
