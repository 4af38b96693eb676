"""Small helpers shared by the operators: reading tables, cutting lineage, salted joins, bounded bit filters."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may be without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="sightline-checkpoint-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of files that Spark wrote, if it is there."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder: later steps read them instead of working them out again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of steps that nothing refers to any more: it finds them when the
    driver collects its garbage, which a long row of steps on little memory may put off until their files fill the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Narrow rows that one task of a step over few rows holds at least.
ROWS_A_TASK = 20_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, which has been cut and has so many rows, in as many partitions as they need: each shuffle writes files by task."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application: they may have no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sightline-package-")), "sightline-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, made ready for Python tasks: the package is sent along, and Arrow batches of this session are limited to 8 MB
    where they could be larger, because ten thousand long texts at once would take a task's memory."""
    ship_package(df.sparkSession)
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    size = re.fullmatch(r"(\d+)([kmg]?)b?", df.sparkSession.conf.get(name, "1g").lower())
    if size is None or int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] > most:
        df.sparkSession.conf.set(name, str(most))
    return df


def giving_back(run):
    """A task's function over Arrow batches that returns its memory to the machine at its end: the worker outlives the task, and
    what it keeps for later counts against the executor."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


#: Most rows of keys that are broadcast (some 50 MB in memory); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 19


def small_or_shuffled(keys: DataFrame) -> DataFrame:
    """A table of one or two longs a row, to be broadcast if it has BROADCAST_ROWS rows or fewer."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: A key with more rows than this, or than one in BROADCAST_ROWS of all rows, is a common one: see joined_by_key().
COMMON_ROWS = 1_000


def joined_by_key(rows: DataFrame, keys: DataFrame, key: str, number: str) -> DataFrame:
    """rows joined with keys, which has one row for each key and in `number` how many of the rows have it.

    Common keys, of which there can't be more than BROADCAST_ROWS, are broadcast, so their rows stay where they are; all
    others are joined by a shuffle.
    """
    total = keys.agg(F.sum(number)).first()[0] or 0
    is_common = F.col(number) > max(COMMON_ROWS, total // BROADCAST_ROWS)
    common = F.broadcast(keys.filter(is_common))
    others = rows.join(F.broadcast(keys.filter(is_common).select(key)), key, "left_anti")
    return rows.join(common, key).unionByName(others.join(keys.filter(~is_common), key))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it different from all columns of df."""
    taken = {c.lower() for c in df.columns}
    longest = max((len(c) - len(c.lstrip("_")) for c in taken), default=0)
    return [n if n.lower() not in taken else "_" * (longest + 1) + n for n in names]


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs but the rows that agree with a row of keys in all of its columns, null with null. Texts are not shuffled for few keys."""
    names = unused(docs, *[f"gone_{c}" for c in keys.columns])
    gone = cut(keys.toDF(*names).distinct())
    met = F.lit(True)
    for c, name in zip(keys.columns, names):
        met = met & F.col(c).eqNullSafe(F.col(name))
    return docs.join(small_or_shuffled(gone), met, "left_anti")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def bit_filter(keys: DataFrame, column: str, bits: int = 23) -> np.ndarray:
    """2**bits places (1 MB at 23, whatever the number of keys); those that the keys' low bits name are set.

    The keys are hashes already. The filter only thins out what a later exact join sees, so a crowded filter costs
    time and never rows.
    """
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def in_filter(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.uint64, copy=False)
    word = (keys & np.uint64(len(places) * 64 - 1)) >> np.uint64(6)
    return (places[word] >> (keys & np.uint64(63))) & np.uint64(1) == 1
