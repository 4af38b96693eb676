"""Structured Streaming forms: messages, tumbling buckets, sessions, stateful counters, hysteresis and expiring values,
change feeds and upserts.

Event time and late data are an extension: what comes later than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline import schemas
from sightline.operators.joins import upserted


def decoded(messages: DataFrame, schema: str = schemas.INGESTED) -> DataFrame:
    """Messages (value: string or binary) parsed; those that cannot be are left out."""
    parsed = messages.select(F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("m"))
    return parsed.filter("m is not null and m.video_id is not null").select("m.*")


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """(video_id, start, n, top) of events (video_id, ts, value)."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy("video_id", w).agg(F.count("*").alias("n"), F.max("value").alias("top")).select("video_id", F.col("window.start").alias("start"), "n", "top")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(video_id, start, end, n): events less than gap apart; end is the last event's time plus gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("video_id", w).agg(F.count("*").alias("n")).select("video_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Groups that keys are dealt to by hash, so that a call of the state's function takes many keys and not one.
DEALT = 4096


class LimitedCounter(StatefulProcessor):
    """Allows a key `limit` times until a reset; a key that is forgotten leaves no state behind. Keys come many at a time."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "none boolean, video_id long", "used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows, ignore_index=True).sort_values(["none", "video_id", "request"], kind="stable")
        videos, requests, allowed = [], pdf["request"].tolist(), []
        own = zip(zip(pdf["none"].tolist(), pdf["video_id"].tolist()), pdf["reset"].tolist(), pdf["forget"].tolist())
        for video, asked in groupby(own, key=itemgetter(0)):
            told = self.used.getValue(video)
            used = told[0] if told else 0
            for _, reset, forget in asked:
                used = -1 if forget else 0 if reset else max(used, 0) + 1
                videos.append(None if video[0] else video[1])
                allowed.append(bool(reset or forget or used <= self.limit))
            if used >= 0:
                self.used.updateValue(video, (used,))
            elif told:
                self.used.removeKey(video)
        yield pd.DataFrame({"video_id": pd.array(videos, "Int64"), "request": requests, "allowed": allowed})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int = 2) -> DataFrame:
    """(video_id, request, allowed) for requests (video_id, request, reset and, if wanted, forget)."""
    requests = requests if "forget" in requests.columns else requests.withColumn("forget", F.lit(False))
    dealt = F.pmod(F.xxhash64("video_id"), F.lit(DEALT)).alias("dealt")
    rows = requests.select(dealt, F.col("video_id").isNull().alias("none"), F.coalesce(F.col("video_id").cast("long"), F.lit(0)).alias("video_id"), "request", "reset", "forget")
    return rows.groupBy("dealt").transformWithStateInPandas(LimitedCounter(limit), "video_id long, request long, allowed boolean", "Append", "None")


class HysteresisRuns(StatefulProcessor):
    """Closes a run when the score falls below release; an open run stays in the state."""

    def __init__(self, threshold: float, release: float):
        self.threshold, self.release = threshold, release

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "start_w long, end_w long, peak double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        run = list(self.run.get()) if self.run.exists() else None
        out = []
        for pdf in rows:
            for w, score in pdf.sort_values("w")[["w", "score"]].itertuples(index=False):
                if run and score >= self.release:
                    run = [run[0], int(w), max(run[2], float(score))]
                elif run:
                    out.append((key[0], *run))
                    run = None
                elif score >= self.threshold:
                    run = [int(w), int(w), float(score)]
        if run:
            self.run.update(tuple(run))
        else:
            self.run.clear()
        yield pd.DataFrame(out, columns=["video_id", "start_w", "end_w", "peak"])

    def close(self) -> None:
        pass


def hysteresis(scores: DataFrame, threshold: float, release: float) -> DataFrame:
    """(video_id, start_w, end_w, peak) of closed runs of scores (video_id, w, score), whose windows come in order of batches."""
    return scores.groupBy("video_id").transformWithStateInPandas(HysteresisRuns(threshold, release), "video_id long, start_w long, end_w long, peak double", "Append", "None")


class Remembered(StatefulProcessor):
    """Answers a key's request from what it was told before, for as long as that is fresh; a told value is kept anew."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for request, value in pdf.sort_values("request")[["request", "value"]].itertuples(index=False):
                known = isinstance(value, str)
                if known:
                    self.value.update((value,))
                found = self.value.get()[0] if self.value.exists() else None
                out.append((key[0], int(request), found, not known and found is not None))
        yield pd.DataFrame(out, columns=["video_id", "request", "value", "hit"])

    def close(self) -> None:
        pass


def remembered(requests: DataFrame, ttl_ms: int = 5_000) -> DataFrame:
    """(video_id, request, value, hit) for requests (video_id, request, value): a null value is looked up in what the key was
    told within the last ttl_ms of processing time, by Spark's state expiry."""
    return requests.groupBy("video_id").transformWithStateInPandas(Remembered(ttl_ms), "video_id long, request long, value string, hit boolean", "Append", "ProcessingTime")


def change_feed(snapshot: DataFrame, key: str, wanted: list[str], emit):
    """A foreachBatch function that hands a subscriber (emit: a function of a DataFrame) what the snapshot holds of the wanted
    keys with the first batch, and then each batch's changes of these keys. Batches may come again, with the same rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch if epoch else snapshot.unionByName(batch, allowMissingColumns=True)
        emit(own.filter(F.col(key).isin(*wanted)))

    return write


def per_recording(steps: list, emit):
    """A foreachBatch function that runs the steps one after another on each batch of ingested recordings, each on what the
    one before gave, and hands the last result to emit. A batch without recordings runs none."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.dropDuplicates(["video_id"])
        if rows.isEmpty():
            return
        for step in steps:
            rows = step(rows)
        emit(rows)

    return write


#: Parts that a table of latest rows is kept in; a batch rewrites those that its keys fall into.
PARTS = 32


def _versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The last version of each part of a table of latest rows, by its log; empty if there is no log."""
    try:
        log = spark.read.schema("part int, version int").parquet(f"{path}/log")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}
    # one row a part: PARTS at most
    return {r.part: r.version for r in log.groupBy("part").agg(F.max("version").alias("version")).collect()}


def latest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_sink() keeps under path, as of the last finished batch. A version that is gone raises."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version of a table in {path}")
    return spark.read.parquet(*[f"{path}/v{v}/part={p}" for p, v in sorted(found.items())])


def upsert_sink(path: str, keys: list[str], version: list[str]):
    """A foreachBatch function that keeps the latest row of each key under path. Replays of a batch change nothing.

    The table is kept in PARTS parts by the keys' hash. A batch writes a new version of the parts that it touches and then
    notes them in a log, from which latest_rows() reads; until then readers see what was there before. A stream that has
    had batches, but finds no log, raises instead of beginning anew, and so does a version that is gone.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found = _versions(spark, path)
        if not found and epoch:
            raise FileNotFoundError(f"batch {epoch}, but no version of the table in {path}")
        part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
        touched = [r[0] for r in batch.select(part.alias("part")).distinct().collect()]
        if not touched and (found or epoch):
            return
        if not touched:
            # the first batch may be empty: the table begins as an empty part, so that the log tells of it
            batch.limit(0).write.mode("overwrite").parquet(f"{path}/v0/part=0")
            spark.createDataFrame([(0, 0)], "part int, version int").coalesce(1).write.mode("append").parquet(f"{path}/log")
            return
        before = [f"{path}/v{found[p]}/part={p}" for p in touched if p in found]
        table = spark.read.parquet(*before) if before else batch.limit(0)
        new = max(found.values(), default=-1) + 1
        upserted(table, batch, keys, version).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{path}/v{new}")
        log = spark.range(1).select(F.explode(F.array(*map(F.lit, touched))).alias("part"), F.lit(new).alias("version"))
        log.coalesce(1).write.mode("append").parquet(f"{path}/log")

    return write
