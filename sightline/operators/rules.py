"""Safety rules over interval events (video_id, pos, label, category, severity, start, end, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.clock import finding_clock
from sightline.operators.folds import first_starts
from sightline.operators.islands import merged_ids
from sightline.operators.joins import overlap_join


def critical_clusters(events: DataFrame) -> DataFrame:
    """(video_id, category, cluster, start, end, best, others, evidence, n, title, detail): critical events of one category that overlap strictly are one finding.

    best is the label with the highest score, the last on ties; others are the labels apart from it, in order of time;
    evidence has a line for each event, its label and its clock times. detail tells when, the best label's score in per
    cent, and the others with theirs.
    """
    critical = merged_ids(events.filter("severity = 'critical'"), ["video_id", "category"], ["start", "pos"], 0.0, "cluster", touching=False)
    rows = F.array_sort(F.collect_list(F.struct("start", "pos", "label", "end", "score")))
    out = critical.groupBy("video_id", "category", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("label", F.struct("score", "pos")).alias("best"), F.max("score").alias("_top"), rows.alias("_rows"), F.count("*").alias("n"))
    others = F.transform(F.filter("_rows", lambda r: r["label"] != F.col("best")), lambda r: r["label"])
    told = F.transform("_rows", lambda r: F.concat(r["label"], F.lit(" "), finding_clock(r["start"]), F.lit("–"), finding_clock(r["end"])))
    percent = lambda x: F.concat(F.lit("%"), F.round(x.cast("double") * 100).cast("long").cast("string"))
    also = F.array_join(F.transform(F.filter("_rows", lambda r: r["label"] != F.col("best")), lambda r: F.concat(r["label"], F.lit(" "), percent(r["score"]))), ", ")
    heard = F.concat(finding_clock(F.col("start")), F.lit("–"), finding_clock(F.col("end")), F.lit(": "), F.col("best"), F.lit(" "), percent(F.col("_top")), F.lit("."))
    out = out.withColumn("title", F.concat(F.col("best"), F.lit(" detected"))).withColumn("detail", F.concat(heard, F.when(also != "", F.concat(F.lit(" Also taken for: "), also, F.lit("."))).otherwise("")))
    return out.withColumn("others", F.array_join(others, ",")).withColumn("evidence", told).drop("_rows", "_top")


def alarm_spans(events: DataFrame, slack: float = 5.0) -> DataFrame:
    """(video_id, span, start, end, pieces): critical alarms at most `slack` seconds apart as one."""
    alarms = events.filter("category = 'alarm' and severity = 'critical'")
    out = merged_ids(alarms, ["video_id"], ["start", "pos"], slack, "span")
    return out.groupBy("video_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("pieces"))


def post_alarm_activity(events: DataFrame, window: float, slack: float = 5.0) -> DataFrame:
    """(video_id, span, alarm_start, last_end, bursts, total): machine sounds within `window` seconds of an alarm's start.

    total is the length of the union of the activity, clipped to the window, and bursts the number of its intervals.
    """
    spans = alarm_spans(events, slack).select("video_id", "span", F.col("start").alias("alarm_start"), F.col("start").alias("v_start"), (F.col("start") + window).alias("v_end"))
    machine = events.filter("category = 'machine'").select("video_id", "pos", "start", "end", F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    met = overlap_join(spans, machine, window)
    clipped = met.withColumn("start", F.greatest("start", "alarm_start")).withColumn("end", F.least(F.col("end"), F.col("alarm_start") + window)).filter("end > start")
    merged = merged_ids(clipped, ["video_id", "span"], ["start", "pos"], 0.0, "burst").groupBy("video_id", "span", "alarm_start", "burst").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("video_id", "span", "alarm_start").agg(F.max("end").alias("last_end"), F.count("*").alias("bursts"), F.sum(F.col("end") - F.col("start")).alias("total"))


def overlap_pairs(events: DataFrame, bucket: float, tolerance: float = 0.0) -> DataFrame:
    """(video_id, v_pos, h_pos, start, end, distress): vehicle sounds with human or distress sounds at the same time."""
    vehicles = events.filter("category = 'vehicle'").select("video_id", F.col("pos").alias("v_pos"), F.col("start").alias("v_start"), F.col("end").alias("v_end"))
    humans = events.filter("category in ('human', 'distress')").select("video_id", F.col("pos").alias("h_pos"), F.col("start").alias("h_start"), F.col("end").alias("h_end"), (F.col("category") == "distress").alias("distress"))
    pairs = overlap_join(vehicles, humans, bucket, tolerance)
    return pairs.select("video_id", "v_pos", "h_pos", F.greatest("v_start", "h_start").alias("start"), F.least("v_end", "h_end").alias("end"), "distress")


def vehicle_near_person(events: DataFrame, bucket: float, tolerance: float = 0.0, strict_severity: bool = False) -> DataFrame:
    """overlap_pairs() without those that start within a second of an earlier finding, and their severity.

    The first pair names the severity; strict_severity raises it if any pair that was left out for it is a distress.
    """
    pairs = overlap_pairs(events, bucket, tolerance)
    kept = first_starts(pairs)
    severity = F.when(F.col("distress"), "critical").otherwise("warning")
    if not strict_severity:
        return kept.withColumn("severity", severity)
    # two starts less than a second apart are those whose half seconds around them overlap
    around = lambda df, a, b: df.withColumn(a, F.col("start") - 0.5).withColumn(b, F.col("start") + 0.5)
    near = around(kept.select("video_id", F.col("v_pos").alias("_v"), F.col("h_pos").alias("_h"), "start"), "v_start", "v_end").drop("start")
    raised = overlap_join(near, around(pairs.filter("distress").select("video_id", "start"), "h_start", "h_end").drop("start"), 60.0)
    raised = raised.select("video_id", F.col("_v").alias("v_pos"), F.col("_h").alias("h_pos")).distinct().withColumn("_raised", F.lit(True))
    return kept.join(raised, ["video_id", "v_pos", "h_pos"], "left").withColumn("severity", F.when(F.col("_raised"), "critical").otherwise(severity)).drop("_raised")


def ordered_findings(events: DataFrame, window: float, bucket: float) -> DataFrame:
    """findings() with nth, their number in a recording by start, then rule, then end."""
    order = F.array_position(F.array(F.lit("critical_sound"), F.lit("post_alarm_activity"), F.lit("vehicle_near_person")), F.col("rule"))
    return findings(events, window, bucket).withColumn("nth", F.row_number().over(Window.partitionBy("video_id").orderBy("start", order, "end", "severity")).cast("long"))


def findings(events: DataFrame, window: float, bucket: float) -> DataFrame:
    """(video_id, rule, severity, start, end): all three rules' findings, to be ordered by start."""
    a = critical_clusters(events).select("video_id", F.lit("critical_sound").alias("rule"), F.lit("critical").alias("severity"), "start", "end")
    b = post_alarm_activity(events, window).select("video_id", F.lit("post_alarm_activity").alias("rule"), F.lit("critical").alias("severity"), F.col("alarm_start").alias("start"), F.col("last_end").alias("end"))
    c = vehicle_near_person(events, bucket).select("video_id", F.lit("vehicle_near_person").alias("rule"), "severity", "start", "end")
    return a.unionByName(b).unionByName(c)
