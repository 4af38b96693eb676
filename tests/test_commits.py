import datetime
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from sightline.streaming import commits as commits_module
from sightline.streaming.commits import Commits, Outdated, change_rows, follow, worked_out_once
from sightline.streaming.loop import MESSAGES, REFUSED, REPORTS, frames_delivered, guarded, recording_loop

ROWS = "video_id string, n int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_commits_are_whole_and_replays_add_nothing(spark, tmp_path, monkeypatch):
    log = Commits(spark, str(tmp_path / "t"))
    assert log.version() == -1 and log.read("a", ROWS).collect() == []
    assert log.commit({"a": rows(spark, ("x", 1)), "b": rows(spark, ("y", 2))}, "first") == 0
    assert log.commit({"a": rows(spark, ("x", 9))}, "first") is None
    assert log.commit({"a": rows(spark, ("x", 3), ("z", 4))}) == 1
    assert got(log.read("a", ROWS), "video_id", "n", "_version") == [("x", 1, 0), ("x", 3, 1), ("z", 4, 1)]
    assert got(log.latest("a", ROWS, ["video_id"]), "video_id", "n") == [("x", 3), ("z", 4)]
    assert got(log.read("a", ROWS, since=0), "n") == [(3,), (4,)] and got(log.read("a", ROWS, until=0), "n") == [(1,)]
    with pytest.raises(Outdated):
        log.commit({"a": rows(spark, ("x", 5))}, expected=0)
    # a writer that is lost before its commit leaves nothing to be seen

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(commits_module, "put_new", lost)
    with pytest.raises(OSError):
        log.commit({"a": rows(spark, ("w", 7)), "b": rows(spark, ("w", 7))}, "second")
    monkeypatch.undo()
    assert log.version() == 1 and got(log.read("b", ROWS), "n") == [(2,)]
    assert log.commit({"a": rows(spark, ("w", 7)), "b": rows(spark, ("w", 7))}, "second") == 2
    assert got(log.read("b", ROWS), "n") == [(2,), (7,)]


def test_writers_take_turns(spark, tmp_path):
    logs = [Commits(spark, str(tmp_path / "t")) for _ in range(4)]
    threads = [threading.Thread(target=lambda k=k: [logs[k].commit({"a": rows(spark, (f"v{k}", i))}) for i in range(3)]) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert logs[0].version() == 11
    assert got(logs[0].read("a", ROWS), "video_id", "n") == sorted((f"v{k}", i) for k in range(4) for i in range(3))


def test_a_subscriber_misses_and_repeats_nothing(spark, tmp_path):
    log = Commits(spark, str(tmp_path / "t"))
    channels = {"reports": ("reports", ROWS), "trace": ("trace", ROWS), "alerts": ("alerts", ROWS)}
    log.commit({"reports": rows(spark, ("x", 1), ("y", 1)), "trace": rows(spark, ("x", 10))})
    log.commit({"reports": rows(spark, ("x", 2))})
    first, at = change_rows(log, channels, "video_id", ["x"], None, "reports")
    assert at == 1 and [(r.channel, r.version, json.loads(r.body)["n"]) for r in first.collect()] == [("reports", 1, 2)]
    # what comes between the snapshot and the first batch
    log.commit({"reports": rows(spark, ("x", 3)), "alerts": rows(spark, ("x", 30), ("y", 31))})
    seen = []

    def emit(df):
        seen.extend((r["video_id"], r["n"], r["_version"]) for r in df.filter("video_id = 'x'").collect())

    def run():
        query = log.new_commits().writeStream.foreachBatch(follow(log, "reports", ROWS, at, emit)).option("checkpointLocation", str(tmp_path / "position")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    assert seen == [("x", 3, 2)]
    log.commit({"reports": rows(spark, ("x", 4))})
    log.commit({"reports": rows(spark, ("y", 5))})
    run()
    assert seen == [("x", 3, 2), ("x", 4, 3)]
    more, until = change_rows(log, channels, "video_id", ["x", "y"], at, "reports")
    assert until == 4 and sorted((r.channel, r.version, r.key) for r in more.collect()) == [("alerts", 2, "x"), ("alerts", 2, "y"), ("reports", 2, "x"), ("reports", 3, "x"), ("reports", 4, "y")]


def test_read_through_store(spark, tmp_path):
    log, asked = Commits(spark, str(tmp_path / "t")), []

    def work(missing):
        asked.append(sorted(tuple(r) for r in missing.collect()))
        return missing.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"), F.length("mark").alias("score"))

    schema = "video_id bigint, idx int, score int"
    want = lambda *x: spark.createDataFrame(list(x), "video_id bigint, mark string")
    assert worked_out_once(log, "profiles", schema, want((1, "a"), (2, "b")), work).count() == 6
    assert worked_out_once(log, "profiles", schema, want((1, "a"), (2, "b"), (1, "a")), work).count() == 6
    assert asked == [[(1, "a"), (2, "b")]]
    changed = worked_out_once(log, "profiles", schema, want((1, "aaa"), (2, "b"), (3, "c")), work)
    assert got(changed.groupBy("video_id").agg(F.count("*").alias("n"), F.max("score").alias("m")), "video_id", "n", "m") == [(1, 3, 3), (2, 3, 1), (3, 3, 1)]
    assert asked[1:] == [[(1, "aaa"), (3, "c")]]
    # two writers that work out the same recording: it is there once, and the others' rows too
    both = [want((7, "x"), (8, "y")), want((7, "x"), (9, "z"))]
    for df in both:
        log.commit({"profiles": work(df), "profiles_marks": df})
    assert got(worked_out_once(log, "profiles", schema, want((7, "x"), (8, "y"), (9, "z")), work).groupBy("video_id").count(), "video_id", "count") == [(7, 3), (8, 3), (9, 3)]
    assert worked_out_once(log, "profiles", schema, want(), work).collect() == []


def message(video, ms=5000, codec="h264", key="raw/x.mp4"):
    return (1, video, key, ms, 25.0, 640, 360, 1000, codec, datetime.datetime(2024, 1, 1))


def test_the_loop_keeps_failures_apart(spark, tmp_path):
    from sightline import schemas

    log = Commits(spark, str(tmp_path / "t"))

    def hear(row):
        if row["video_id"] == "deaf":
            raise RuntimeError("no sound track")
        return {"context": f"heard {row['video_id']}"}

    def see(row):
        if row["video_id"] == "dark" and not os.path.exists(tmp_path / "light"):
            raise ValueError("too dark")
        return {"summary": row["context"], "events": "[]", "risk": "low", "actions": ["look"]}

    step = recording_loop(log, "loop", guarded(hear, "context string"), guarded(see, "summary string, events string, risk string, actions array<string>"))
    batch = spark.createDataFrame([message("good"), message("deaf", codec="av1"), message("dark"), message("still", ms=40), message("good"), message("gone", key=None), message(None)], schemas.INGESTED)
    step(batch, 0)
    step(batch, 0)
    assert got(log.read("reports", REPORTS), "video_id", "summary", "with_sound") == [("deaf", "", False), ("good", "heard good", True)]
    assert got(log.read("refused", REFUSED), "video_id", "reason") == [("gone", "no_object"), ("still", "too_short")]
    assert got(log.read("catalog", "video_id string, transcode boolean"), "video_id", "transcode") == [("dark", False), ("deaf", True), ("good", False)]
    told = got(log.read("messages", MESSAGES), "channel", "video_id", "body")
    assert [x for x in told if x[0] == "reports"] == [("reports", "deaf", "deaf"), ("reports", "good", "good")]
    assert ("trace", "deaf", "no sound: RuntimeError: no sound track") in told and ("trace", "dark", "no report: ValueError: too dark") in told
    # the messages come again with a later batch: only what has no report yet is worked on
    (tmp_path / "light").touch()
    step(batch, 1)
    assert got(log.read("reports", REPORTS), "video_id") == [("dark",), ("deaf",), ("good",)]
    assert len(got(log.read("messages", MESSAGES).filter("channel = 'reports'"), "video_id")) == 3
    step(batch.limit(0), 2)
    assert len(got(log.read("messages", MESSAGES).filter("channel = 'reports'"), "video_id")) == 3


def test_frames_come_with_their_message(spark, tmp_path):
    log = Commits(spark, str(tmp_path / "t"))
    chosen = spark.createDataFrame([("v", 200, 0.5, True), ("v", 100, 0.25, False)], "video_id string, t_ms bigint, score double, is_scene_cut boolean")
    extracted = spark.createDataFrame([("v", 200, "k2"), ("v", 100, "k1"), ("w", 5, "k5")], "video_id string, t_ms bigint, object_key string")
    assert frames_delivered(log, chosen, extracted, "overview", "b1") == 0 and frames_delivered(log, chosen, extracted, "overview", "b1") is None
    assert got(log.read("frame_refs", "video_id string, t_ms bigint, motion_score float, is_scene_cut boolean"), "video_id", "t_ms", "motion_score", "is_scene_cut") == [("v", 100, 0.25, False), ("v", 200, 0.5, True), ("w", 5, 0.0, False)]
    told = {r.video_id: json.loads(r.body) for r in log.read("messages", MESSAGES).collect()}
    assert [f["object_key"] for f in told["v"]["frames"]] == ["k1", "k2"] and told["w"]["pass"] == "overview" and told["w"]["batch_id"] == "b1"
