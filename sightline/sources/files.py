"""File sources and sinks: labels, truth, catalogs, media listings, keyed tables."""

from __future__ import annotations

import os
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schemas
from sightline.functions.checks import rational
from sightline.functions.text import PLACEHOLDER

# Media extensions, in order of preference when one name has several.
MEDIA_EXTENSIONS = ("mp4", "mkv", "webm", "mov", "avi", "flv", "wmv", "m4v")


def class_labels(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(class_index, mid, display_name) from CSV; a row that does not fit fails the read, a wrong number of rows raises."""
    rows = spark.read.csv(path, header=True, schema=schemas.CLASS_LABELS, mode="FAILFAST")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} class labels, {expected} expected")
    return rows


def translated_labels(labels: DataFrame, translations: DataFrame, safety: DataFrame) -> DataFrame:
    """labels with their translation (else the original) and, where they have one, their safety severity and category."""
    out = labels.join(F.broadcast(translations), "display_name", "left").withColumn("display_name_tr", F.coalesce("display_name_tr", "display_name"))
    return out.join(F.broadcast(safety.withColumnRenamed("label", "display_name")), "display_name", "left")


def ground_truth(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(video, duration_ms, t_ms, event, severity) from a folder of JSON files, one a recording, in order of the recordings'
    names; with a limit, of the first so many. A folder that is not there, or holds no such file, raises."""
    rows = spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("_file", F.input_file_name()).orderBy("video", "_file")
    if rows.isEmpty():
        raise FileNotFoundError(f"no JSON file in {folder}")
    rows = rows if limit is None else rows.limit(limit)
    return rows.select("video", "duration_ms", F.explode_outer("events").alias("e")).select("video", "duration_ms", "e.t_ms", "e.event", "e.severity")


def catalog(spark: SparkSession, folder: str, one_a_file: bool = True) -> DataFrame:
    """Catalog records, newest first; files (or lines, if one_a_file is false) that cannot be read as one are left out."""
    rows = spark.read.schema(schemas.CATALOG).option("multiLine", one_a_file).option("mode", "DROPMALFORMED").json(folder)
    return rows.filter("id is not null").orderBy(F.col("uploaded_at").desc(), "id")


def catalog_record(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The catalog's record of one recording: one row, or none."""
    return catalog(spark, folder).filter(F.col("id") == key).limit(1)


def in_catalog(spark: SparkSession, folder: str, key: str) -> bool:
    return not catalog_record(spark, folder, key).isEmpty()


def skipped_records(spark: SparkSession, folder: str) -> int:
    """How many files of a catalog cannot be read as a record."""
    return spark.read.schema(schemas.CATALOG).option("multiLine", True).json(folder).filter("id is null").count()


def object_listing(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(key, length) of stored objects under a folder by key: those whose key begins with prefix, without unfinished .part files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    root = folder.rstrip("/").split("://")[-1]
    name = F.substring(F.col("path"), F.locate(root, F.col("path")) + F.lit(len(root) + 1), F.lit(1 << 20))
    return files.select(name.alias("key"), "length").filter(F.col("key").startswith(prefix) & ~F.col("key").endswith(".part")).orderBy("key")


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, extension, length) of media files by name, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.withColumn("extension", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).withColumn("stem", F.regexp_replace(name, r"\.[^.]+$", ""))
    return out.filter(F.col("extension").isin(*MEDIA_EXTENSIONS)).select("path", "stem", "extension", "length").orderBy("stem", "path")


def by_stem(files: DataFrame) -> DataFrame:
    """(stem, path): one file for each name, by the preferred extension."""
    rank = F.array_position(F.array(*map(F.lit, MEDIA_EXTENSIONS)), F.col("extension"))
    return files.groupBy("stem").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def labelled_images(spark: SparkSession, folder: str, normal: str = "normal_ops") -> DataFrame:
    """(path, category, label): the category is the folder, label 0 for the normal one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    category = F.element_at(F.split("path", "/"), -2)
    return files.select("path", category.alias("category"), F.when(category == normal, 0).otherwise(1).alias("label"))


#: The variable that names a folder of prompt catalogs, which then counts instead of the paths given.
PROMPT_FOLDER = "SIGHTLINE_PROMPTS"


def prompt_paths(given: list[str], variable: str = PROMPT_FOLDER) -> list[str]:
    """The paths of the folder that the environment names, else those given. A folder without a TOML file raises."""
    folder = os.environ.get(variable)
    if not folder:
        return given
    found = sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".toml"))
    if not found:
        raise FileNotFoundError(f"no TOML file in {folder}")
    return found


def prompt_fragments(spark: SparkSession, paths: list[str], known: set[str] | None = None) -> DataFrame:
    """(agent, fragment, editable, text, names) from TOML files of [fragment] tables, read on the driver: a catalog is a few files.

    With known, the names that a context can fill in, a text with any other placeholder raises ValueError, so that a broken
    catalog is found when it is read. Of one agent's several files the last counts.
    """
    agents = {}
    for path in paths:
        with open(path, "rb") as file:
            data = tomllib.load(file)
        agent = data.get("agent", "")
        agents[agent] = [(agent, k, bool(v.get("editable", False)), v["text"]) for k, v in sorted(data.items()) if isinstance(v, dict) and "text" in v]
    rows = [r for own in agents.values() for r in own]
    for agent, fragment, _, text in rows if known is not None else ():
        if unknown := set(re.findall(PLACEHOLDER, text)) - known:
            raise ValueError(f"{agent}/{fragment} has placeholders that nothing fills in: {', '.join(sorted(unknown))}")
    out = spark.createDataFrame(rows, "agent string, fragment string, editable boolean, text string")
    return out.withColumn("names", F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), 1)))


def probe_fields(probe_json: Column) -> Column:
    """Container facts from probe JSON: the average frame rate, else the real one; the format's duration, else the stream's."""
    at = lambda path: F.get_json_object(probe_json, path)
    fps = F.coalesce(F.nullif(rational(at("$.streams[0].avg_frame_rate")), F.lit(0.0)), F.nullif(rational(at("$.streams[0].r_frame_rate")), F.lit(0.0)))
    seconds = F.coalesce(at("$.format.duration").try_cast("double"), at("$.streams[0].duration").try_cast("double"))
    return F.struct(
        F.round(seconds * 1000).cast("long").alias("duration_ms"),
        fps.alias("fps"),
        at("$.streams[0].width").try_cast("int").alias("width"),
        at("$.streams[0].height").try_cast("int").alias("height"),
        at("$.format.size").try_cast("long").alias("size_bytes"),
        F.coalesce(at("$.streams[0].codec_name"), F.lit("unknown")).alias("codec"),
    )


def safe_key(key: Column) -> Column:
    """Whether a storage key has only plain path parts."""
    parts = F.split(key, "/")
    return F.coalesce((F.size(parts) > 0) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def ingest_gate(probed: DataFrame, least_ms: int = 200) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): recordings with a sound probe and a duration of at least least_ms, and the others with their reason."""
    reason = F.when(F.col("fps").isNull(), "no frame rate").when(F.coalesce(F.col("duration_ms"), F.lit(0)) <= 0, "no duration").when(F.col("duration_ms") < least_ms, "too short").when(~safe_key(F.col("object_key")), "bad key")
    out = probed.withColumn("reason", reason)
    return out.filter("reason is null").drop("reason"), out.filter("reason is not null")


def write_table(df: DataFrame, path: str) -> None:
    """Parquet through Spark's commit protocol: readers see all of it or nothing."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
