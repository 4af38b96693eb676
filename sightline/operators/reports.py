"""Incident reports: lenient parsing, defaults, rebasing, merging of chunks, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.clock import minute_clock, parse_clock
from sightline.functions.text import json_body, non_blank, severity_of, severity_rank

#: What a model's answer may hold; everything is optional.
ANSWER = "struct<zoom:struct<t0:double,t1:double>,summary:string,events:array<struct<time:string,t_ms:bigint,event:string,severity:string>>,risk:string,actions:array<string>,arguments:string>"


def parsed_answers(texts: DataFrame) -> DataFrame:
    """texts (id, text) with kind (zoom, report or error) and the parsed answer; JSON is looked for between the first { and the last }.

    An answer wrapped as a tool call ({"arguments": "..."}) is unwrapped.
    """
    first = texts.withColumn("_a", F.from_json(json_body(F.col("text")), ANSWER))
    answer = F.coalesce(F.from_json(F.col("_a.arguments"), ANSWER), F.col("_a"))
    kind = F.when(F.col("answer.zoom.t1") > F.col("answer.zoom.t0"), "zoom").when(F.col("answer.summary").isNotNull() | (F.size(F.coalesce("answer.events", F.array())) > 0), "report").otherwise("error")
    return first.withColumn("answer", answer).drop("_a").withColumn("kind", kind)


def event_time(time: Column, ms: Column) -> Column:
    """The time of an event: its text if that can be read, else its milliseconds, else 0."""
    return F.coalesce(parse_clock(time), ms, F.lit(0).cast("long"))


def delivered(reports: DataFrame) -> DataFrame:
    """The narrow form that reports are delivered in: (video_id, summary, events, risk, actions) with events as (time, event)."""
    events = F.transform("events", lambda e: F.struct(e["time"].alias("time"), e["event"].alias("event")))
    return reports.select("video_id", "summary", events.alias("events"), "risk", "actions")


def with_defaults(summary: Column, actions: Column, said: str, action: str) -> Column:
    """(summary, actions) of a report, with said for a blank summary and action where there is none."""
    told = F.when(F.size(F.coalesce(actions, F.array().cast("array<string>"))) == 0, F.array(F.lit(action))).otherwise(actions)
    return F.struct(F.coalesce(non_blank(summary), F.lit(said)).alias("summary"), told.alias("actions"))


# The summary and the action of a report that has none.
NO_SUMMARY = "Kayıt analiz edildi; özet üretilemedi."
NO_ACTION = "Kaydı incelemeye al ve olayı raporla"


def completed(reports: DataFrame, said: str = NO_SUMMARY, action: str = NO_ACTION) -> DataFrame:
    """reports (video_id, summary, risk, events, actions) with defaults: said for a blank summary, action where there is none,
    and for an empty risk the highest level of the events (low without any); a risk's text becomes its level. Events (structs
    with severity, a text) get their level too."""
    levels = F.transform(F.coalesce("events", F.from_json(F.lit("[]"), reports.schema["events"].dataType)), lambda e: severity_of(e["severity"]))
    worst = F.when(F.array_contains(levels, "high"), "high").when(F.array_contains(levels, "medium"), "medium").otherwise("low")
    risk = F.when(F.coalesce("risk", F.lit("")) == "", worst).otherwise(severity_of(F.col("risk")))
    told = with_defaults(F.col("summary"), F.col("actions"), said, action)
    events = F.transform("events", lambda e: e.withField("severity", severity_of(e["severity"])))
    return reports.select("video_id", told["summary"].alias("summary"), risk.alias("risk"), events.alias("events"), told["actions"].alias("actions"))


def result_document(settings: dict, rows: DataFrame, total: DataFrame) -> DataFrame:
    """(part, body): a benchmark's result as JSON, one line for the settings, one for each row of rows (in a line of its own,
    since there may be many) and one for the total."""
    own = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("body"))
    said = rows.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in settings.items()])
    return own(said, "settings").union(own(rows, "video")).union(own(total, "total"))


def report_lines(results: DataFrame) -> DataFrame:
    """(section, variant, place, line): the lines of a Markdown report on repeated runs, from results (variant, run, video, matched,
    truth, produced, error) with a row for each variant, run and video.

    Section compared has a line for each variant: mean matched of the first run's truth, the least and most, errors of
    results, mean events produced. Section stability has three, the recordings that are the same in all runs, that are
    not, and that never gave a report; false_alarms one for each recording without events; runs one for each recording.
    A line is as long as a variant has recordings.
    """
    ok = F.when(~F.col("error"), F.col("matched"))
    text = lambda c: F.col(c).cast("string")
    one = lambda c: F.round(c, 1).cast("decimal(18,1)").cast("string")
    runs = results.groupBy("variant", "run").agg(F.sum(F.coalesce(ok, F.lit(0))).alias("matched"), F.sum("truth").alias("truth"), F.sum("produced").alias("produced"), F.count_if("error").alias("errors"), F.count("*").alias("n"))
    by = runs.groupBy("variant").agg(F.avg("matched").alias("mean"), F.min_by("truth", "run").alias("truth"), F.min("matched").alias("low"), F.max("matched").alias("high"), F.sum("errors").alias("errors"), F.sum("n").alias("n"), F.avg("produced").alias("produced"))
    line = F.concat(F.lit("| `"), "variant", F.lit("` | "), one("mean"), F.lit("/"), text("truth"), F.lit(" | "), text("low"), F.lit("–"), text("high"), F.lit(" | "), text("errors"), F.lit("/"), text("n"), F.lit(" | "), one("produced"), F.lit(" |"))
    compared = by.select(F.lit("compared").alias("section"), "variant", F.lit("").alias("place"), line.alias("line"))

    state = F.coalesce(ok, F.lit(-1))
    videos = results.groupBy("variant", "video").agg((F.count_if("error") == F.count("*")).alias("never"), (F.min(state) == F.max(state)).alias("same"), F.min(ok).alias("low"), F.max(ok).alias("high"))
    kind = F.when(F.col("never"), "always an error").when(F.col("same"), "stable").otherwise("volatile")
    told = F.concat("video", F.when(kind == "volatile", F.concat(F.lit(" ("), text("low"), F.lit("–"), text("high"), F.lit(")"))).otherwise(""))
    found = videos.groupBy("variant", kind.alias("kind")).agg(F.array_sort(F.collect_list(F.struct("video", told.alias("told")))).alias("l"))
    kinds = results.select("variant").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, ("stable", "volatile", "always an error")))))
    names = F.array_join(F.transform("l", lambda x: x["told"]), ", ")
    line = F.concat(F.lit("- "), "kind", F.lit(" ("), F.coalesce(F.size("l"), F.lit(0)).cast("string"), F.lit("): "), F.coalesce(names, F.lit("none")))
    stability = kinds.join(found, ["variant", "kind"], "left").select(F.lit("stability").alias("section"), "variant", F.col("kind").alias("place"), line.alias("line"))

    def rows(df: DataFrame, section: str, cell: Column, between: str) -> DataFrame:
        cells = df.groupBy("variant", "video").agg(F.array_sort(F.collect_list(F.struct("run", cell.alias("cell")))).alias("l"))
        line = F.concat(F.lit("| "), "video", F.lit(" | "), F.array_join(F.transform("l", lambda x: x["cell"]), between), F.lit(" |"))
        return cells.select(F.lit(section).alias("section"), "variant", F.col("video").alias("place"), line.alias("line"))

    quiet = results.join(results.groupBy("variant", "video").agg(F.min_by("truth", "run").alias("_first")).filter("_first = 0").drop("_first"), ["variant", "video"], "left_semi")
    alarms = rows(quiet, "false_alarms", F.when(F.col("error"), "error").otherwise(text("produced")), ", ")
    cell = F.when(F.col("error"), "**error**").otherwise(F.concat(text("matched"), F.lit("/"), text("truth"), F.lit(" ("), text("produced"), F.lit(")")))
    return compared.unionByName(stability).unionByName(alarms).unionByName(rows(results, "runs", cell, " | "))


def merged_reports(reports: DataFrame, action: str | None = None) -> DataFrame:
    """(video_id, summary, risk, actions) of reports (video_id, seq, summary, risk, actions) in order of seq.

    Non-blank summaries are joined, the highest risk counts, actions are kept once each in order of first sight; where no
    report has any, action is theirs, if given.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "summary", "risk", "actions")))
    out = reports.groupBy("video_id").agg(rows.alias("_r"), F.max_by("risk", severity_rank(F.col("risk"))).alias("risk"))
    told = F.array_join(F.transform(F.filter("_r", lambda r: F.trim(F.coalesce(r["summary"], F.lit(""))) != ""), lambda r: F.trim(r["summary"])), " ")
    actions = F.array_distinct(F.flatten(F.transform("_r", lambda r: F.coalesce(r["actions"], F.array().cast("array<string>")))))
    if action is not None:
        actions = F.when(F.size(actions) == 0, F.array(F.lit(action))).otherwise(actions)
    return out.select("video_id", told.alias("summary"), F.coalesce("risk", F.lit("low")).alias("risk"), actions.alias("actions"))


def audio_digest(events: DataFrame, k: int = 12) -> DataFrame:
    """(video_id, digest): the k most confident events (label, start_sec, end_sec, confidence) in order of time, and how many more there are."""
    rank = Window.partitionBy("video_id").orderBy(F.col("confidence").desc(), "start_sec", "label")
    rows = events.filter("label is not null and start_sec is not null and end_sec is not null").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    rows = rows.withColumn("_nth", F.row_number().over(rank)).withColumn("_n", F.count("*").over(Window.partitionBy("video_id"))).filter(F.col("_nth") <= k)
    line = F.concat(minute_clock(F.col("start_sec")), F.lit("–"), minute_clock(F.col("end_sec")), F.lit(" "), F.col("label"), F.lit(" (%"), F.round(F.col("confidence") * 100).cast("long").cast("string"), F.lit(")"))
    out = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "_nth", line.alias("line")))).alias("_l"), F.max("_n").alias("_n"))
    tail = F.when(F.col("_n") > k, F.concat(F.lit("; "), (F.col("_n") - k).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return out.select("video_id", F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "; "), tail).alias("digest"))


def severities(events: DataFrame, text: str) -> DataFrame:
    return events.withColumn("severity", severity_of(F.col(text)))
