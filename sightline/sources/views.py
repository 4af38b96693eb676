"""The engine's logical inputs (frames, profiles, class scores, interval events, truth, fingerprints) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.bits import gradient_bits
from sightline.operators.profile import normalised

#: Rule inputs by kind of event: (kind, category, severity).
DIMENSION = (("error", "alarm", "critical"), ("signup", "distress", "critical"), ("purchase", "vehicle", "warning"), ("view", "machine", "info"), ("click", "human", "info"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, idx, t_ms, raw, event_type, event_id): a user's events in order of time, times from the first."""
    user = Window.partitionBy("video_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, folder, "events").select(F.col("user_id").alias("video_id"), ms.alias("_ms"), "ts", F.col("value").alias("raw"), "event_type", "event_id")
    rows = rows.withColumn("idx", (F.row_number().over(user.orderBy("ts", "event_id")) - 1).cast("long")).withColumn("t_ms", F.col("_ms") - F.min("_ms").over(user))
    return rows.select("video_id", "idx", "t_ms", "raw", "event_type", "event_id")


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """frames with score, and errors as scene cuts."""
    return normalised(frames(spark, folder)).withColumn("is_scene_cut", F.col("event_type") == "error")


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, event_type, w, score): windows of each class in order of time."""
    w = F.row_number().over(Window.partitionBy("video_id", "event_type").orderBy("t_ms", "event_id")) - 1
    return profile(spark, folder).withColumn("w", w.cast("long")).select("video_id", "event_type", "w", "score")


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIMENSION), "label string, category string, severity string")


def interval_events(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, pos, label, category, severity, start, end, score): each event with a length by its value."""
    rows = profile(spark, folder).withColumnRenamed("event_type", "label").withColumn("start", F.col("t_ms") / F.lit(1000.0))
    rows = rows.withColumn("end", F.col("start") + F.col("raw") * 600)
    return rows.join(F.broadcast(dimension(spark)), "label").select("video_id", F.col("event_id").alias("pos"), "label", "category", "severity", "start", "end", "score")


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return frames(spark, folder).filter("event_type = 'error'").select("video_id", "t_ms")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return frames(spark, folder).filter("event_type = 'purchase'").select("video_id", "t_ms")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, dhash): the signs of an embedding's steps as bits."""
    return table(spark, folder, "embeddings").select("vec_id", gradient_bits(F.col("embedding"), 63).alias("dhash"))


def fingerprinted_profile(spark: SparkSession, folder: str) -> DataFrame:
    """profile with dhash: row idx of a recording has the fingerprint numbered (video_id * 31 + idx) mod their number."""
    number = table(spark, folder, "embeddings").count()
    rows = profile(spark, folder).withColumn("_vec", F.pmod(F.col("video_id") * 31 + F.col("idx"), F.lit(number)))
    marks = fingerprints(spark, folder).select(F.col("vec_id").alias("_vec"), "dhash")
    return rows.join(marks, "_vec").drop("_vec")
