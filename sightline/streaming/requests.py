"""Requests to tools and their replies as a stream: one reply for each request, errors included."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.streaming.commits import Commits

PREFIX = "stream.tool."
REPLIES = "reply string, tool string, code string, body string"


def routed(messages: DataFrame, catalog: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(reply, tool, payload, code) of messages (subject, reply, payload): those under the prefix that name a reply.

    code is null for what can be dispatched, else unknown_tool or bad_request (a payload that is no JSON). catalog has name.
    """
    rows = messages.filter(F.col("subject").startswith(prefix) & F.col("reply").isNotNull())
    rows = rows.select("reply", F.substring("subject", len(prefix) + 1, 1_000).alias("tool"), F.col("payload").cast("string").alias("payload"))
    known = catalog.select(F.col("name").alias("tool"), F.lit(True).alias("_known")).distinct()
    bad = F.try_parse_json("payload").isNull()
    code = F.when(F.col("_known").isNull(), "unknown_tool").when(bad, "bad_request")
    return rows.join(known, "tool", "left").select("reply", "tool", "payload", code.alias("code"))


def answered(requests: DataFrame, handlers: dict[str, Callable[[dict], dict]]) -> DataFrame:
    """(reply, tool, code, body) of routed() requests: code is ok with the handler's answer as JSON, or what is wrong.

    A handler that raises ValueError refuses its request (bad_request); whatever else it raises is `internal`. Neither
    touches other requests. A tool that the catalog knows and no handler serves is unknown_tool too.
    """

    def answer(tool: str, payload: str, code: str | None) -> tuple[str, str]:
        if code is not None:
            return code, json.dumps({"message": f"{code}: {tool}"})
        if tool not in handlers:
            return "unknown_tool", json.dumps({"message": f"unknown_tool: {tool}"})
        try:
            return "ok", json.dumps(handlers[tool](json.loads(payload)), ensure_ascii=False)
        except ValueError as error:
            return "bad_request", json.dumps({"message": str(error)}, ensure_ascii=False)
        except Exception as error:  # a handler's fault is its request's alone
            return "internal", json.dumps({"message": f"{type(error).__name__}: {error}"}, ensure_ascii=False)

    def run(parts):
        for pdf in parts:
            told = [answer(t, p, c if isinstance(c, str) else None) for t, p, c in zip(pdf["tool"], pdf["payload"], pdf["code"])]
            yield pd.DataFrame({"reply": pdf["reply"], "tool": pdf["tool"], "code": [x[0] for x in told], "body": [x[1] for x in told]})

    return requests.mapInPandas(run, REPLIES)


def reply_sink(commits: Commits, name: str, catalog: DataFrame, handlers: dict[str, Callable[[dict], dict]]):
    """A foreachBatch function over messages (subject, reply, payload): replies, and an alert for each tool that was carried
    out, come with one commit a batch. A request that comes twice in a batch is answered once."""

    def write(batch: DataFrame, epoch: int) -> None:
        commit_id = f"{name}:{epoch}"
        if commits.has(commit_id):
            return
        replies = answered(routed(batch.dropDuplicates(["reply"]), catalog), handlers).persist()
        try:
            done = replies.filter("code = 'ok'")
            alerts = done.select(F.lit("alerts").alias("channel"), F.get_json_object("body", "$.video_id").alias("video_id"), F.lit(0).alias("seq"), F.to_json(F.struct("tool", "body")).alias("body"))
            commits.commit({"replies": replies, "messages": alerts.filter("video_id is not null")}, commit_id)
        finally:
            replies.unpersist()

    return write
