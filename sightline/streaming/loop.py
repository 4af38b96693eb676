"""The loop over new recordings: gate and catalog, optional sound, vision, report and messages, one commit a batch.

A recording that fails leaves the others alone: its steps tell a status and a reason. Without its sound it goes on, without
its vision it is left out. Reports, catalog rows, refused recordings and messages of a batch come with one commit, so a
replay adds nothing and no message is lost or sent without its report.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sightline import schemas
from sightline.functions.checks import needs_transcode
from sightline.streaming.commits import Commits

REPORTS = "video_id string, summary string, events string, risk string, actions array<string>, with_sound boolean"
REFUSED = "video_id string, reason string"
MESSAGES = "channel string, video_id string, seq int, body string"
FRAME_REFS = "video_id string, t_ms bigint, object_key string, motion_score float, is_scene_cut boolean"
#: Shortest recording that is no still picture, in milliseconds.
LEAST_MS = 200


def guarded(work: Callable[[dict], dict], result: str) -> Callable[[DataFrame], DataFrame]:
    """A step that calls work on each row (a dict) in the tasks: (video_id, status, reason and the columns of result).

    status is ok; or failed, with the error's text as reason and nulls, if work raises.
    """
    kinds = StructType.fromDDL(result)
    names = kinds.fieldNames()

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    got = work(row)
                    out.append((row["video_id"], "ok", None, *[got.get(n) for n in names]))
                except Exception as error:  # whatever a recording's work raises is that recording's
                    out.append((row["video_id"], "failed", f"{type(error).__name__}: {error}"[:500], *[None] * len(names)))
            yield pd.DataFrame(out, columns=["video_id", "status", "reason", *names]).astype(object)

    full = StructType().add("video_id", StringType()).add("status", StringType()).add("reason", StringType())
    for field in kinds:
        full = full.add(field)
    return lambda rows: rows.mapInPandas(run, full)


def gated(ingested: DataFrame, least_ms: int = LEAST_MS) -> DataFrame:
    """ingested with refused, why a recording can't be taken (null if it can), and transcode, whether its codec must be changed."""
    unread = F.col("duration_ms").isNull() | F.col("codec").isNull() | (F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0)
    refused = F.when(F.col("object_key").isNull(), "no_object").when(unread, "unreadable").when(F.col("duration_ms") < least_ms, "too_short")
    return ingested.withColumn("refused", refused).withColumn("transcode", needs_transcode(F.col("codec")))


def _messages(rows: DataFrame, channel: str, seq: int, body) -> DataFrame:
    return rows.select(F.lit(channel).alias("channel"), "video_id", F.lit(seq).alias("seq"), body.alias("body"))


def recording_loop(commits: Commits, name: str, sound: Callable[[DataFrame], DataFrame], vision: Callable[[DataFrame], DataFrame]):
    """A foreachBatch function over ingested recordings (schemas.INGESTED).

    sound and vision are steps as guarded() makes them; sound's result has context, vision gets the recordings with
    context (null without sound) and its result has summary, events, risk and actions. Recordings that an earlier batch
    has finished or refused are not worked on again; those whose vision failed are, when their message comes again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        commit_id = f"{name}:{epoch}"
        if commits.has(commit_id):
            return
        rows = batch.dropDuplicates(["video_id"]).filter("video_id is not null")
        for table, schema in (("reports", REPORTS), ("refused", REFUSED)):
            rows = rows.join(commits.read(table, schema).select("video_id").distinct(), "video_id", "left_anti")
        rows = gated(rows).persist()
        try:
            taken = rows.filter("refused is null").drop("refused")
            heard = sound(taken).select("video_id", F.col("status").alias("sound_status"), F.col("reason").alias("sound_reason"), "context")
            seen = taken.join(heard, "video_id", "left").persist()
            told = vision(seen).persist()
            done, failed = told.filter("status = 'ok'"), told.filter("status <> 'ok'")
            reports = done.join(seen.select("video_id", (F.coalesce("sound_status", F.lit("none")) == "ok").alias("with_sound")), "video_id")
            reports = reports.select("video_id", F.coalesce("summary", F.lit("")).alias("summary"), "events", F.coalesce("risk", F.lit("")).alias("risk"), "actions", "with_sound")
            trace = _messages(rows, "trace", 0, F.concat(F.lit("ingested"), F.coalesce(F.concat(F.lit(", refused: "), "refused"), F.lit(""))))
            trace = trace.unionByName(_messages(seen.filter("sound_status = 'failed'"), "trace", 1, F.concat(F.lit("no sound: "), "sound_reason")))
            trace = trace.unionByName(_messages(failed, "trace", 2, F.concat(F.lit("no report: "), "reason")))
            trace = trace.unionByName(_messages(done, "trace", 3, F.lit("report written")))
            messages = trace.unionByName(_messages(done, "reports", 4, F.col("video_id")))
            info = F.struct("duration_ms", "fps", "width", "height", "size_bytes", "codec")
            catalog = taken.select("video_id", "object_key", info.cast(schemas.VIDEO_INFO).alias("info"), "ingested_at", "transcode")
            commits.commit({"catalog": catalog, "refused": rows.filter("refused is not null").select("video_id", F.col("refused").alias("reason")), "reports": reports, "messages": messages}, commit_id)
            seen.unpersist()
            told.unpersist()
        finally:
            rows.unpersist()

    return write


def frames_delivered(commits: Commits, chosen: DataFrame, extracted: DataFrame, which: str, commit_id: str) -> int | None:
    """Commits the frames that were extracted and, with them, one message for each recording.

    extracted (video_id, t_ms, object_key) are the frames that there are; chosen (video_id, t_ms, score, is_scene_cut) tells
    of those that were asked for, and the others have a score of 0 and no cut. which names the pass. The message lists a
    recording's frames in order of time; a recording has as many as a budget chose.
    """
    asked = chosen.select("video_id", "t_ms", F.col("score").cast("float").alias("_score"), F.col("is_scene_cut").alias("_cut"))
    refs = extracted.join(asked, ["video_id", "t_ms"], "left").select("video_id", "t_ms", "object_key", F.coalesce("_score", F.lit(0.0).cast("float")).alias("motion_score"), F.coalesce("_cut", F.lit(False)).alias("is_scene_cut"))
    frames = F.array_sort(F.collect_list(F.struct("t_ms", "object_key", "motion_score", "is_scene_cut")))
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), "video_id", F.lit(commit_id).alias("batch_id"), F.lit(which).alias("pass"), "frames"))
    messages = refs.groupBy("video_id").agg(frames.alias("frames")).select(F.lit("frames").alias("channel"), "video_id", F.lit(0).alias("seq"), body.alias("body"))
    return commits.commit({"frame_refs": refs, "messages": messages}, commit_id)
