"""Queries on class scores, interval events, safety rules and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import islands, joins, metrics, reports, rules, segments
from sightline.plans import sql as S
from sightline.plans.book import Book
from sightline.sources import views

Q = Book()
KEYS = ["video_id", "event_type"]
WINDOW, TOLERANCE, BUCKET = 86_400.0, 21_600_000, 43_200.0
r6 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)

_RUNS = f"""WITH {S.SCORES}, sig AS (SELECT *, CASE WHEN score >= 0.35::DOUBLE THEN 1 WHEN score < 0.21::DOUBLE THEN 0 END AS s FROM scores),
st AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY video_id, event_type ORDER BY w ROWS UNBOUNDED PRECEDING), 0) AS state FROM sig),
ri AS (SELECT *, CASE WHEN state = 1 AND coalesce(lag(state) OVER (PARTITION BY video_id, event_type ORDER BY w), 0) = 0 THEN 1 ELSE 0 END AS rise FROM st),
nr AS (SELECT *, sum(rise) OVER (PARTITION BY video_id, event_type ORDER BY w) AS run FROM ri WHERE true),
runs AS (SELECT video_id, event_type, run, min(w) AS start_w, max(w) AS end_w, max(score)::DOUBLE AS peak, arg_max(w, [score::DOUBLE, -w::DOUBLE]) AS peak_w, sum(score::DOUBLE) AS total, count(*) AS n FROM nr WHERE state = 1 GROUP BY ALL)"""
_MERGED = (
    _RUNS
    + """, gaps AS (SELECT *, start_w - lag(end_w) OVER (PARTITION BY video_id, event_type ORDER BY start_w) - 1 AS gap FROM runs),
isl AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, event_type ORDER BY start_w) AS isle FROM gaps),
merged AS (SELECT video_id, event_type, isle, min(start_w) AS start_w, max(end_w) AS end_w, max(peak) AS peak, arg_max(peak_w, [peak, -start_w::DOUBLE]) AS peak_w, sum(total) AS total, sum(n) AS n FROM isl GROUP BY ALL)"""
)
_SEGMENTS = _MERGED + """, seg AS (SELECT video_id, event_type, start_w * 0.5::DOUBLE AS start_sec, end_w * 0.5::DOUBLE + 2 AS end_sec, peak_w * 0.5::DOUBLE + 1 AS peak_sec, peak AS confidence, total / n AS mean_confidence
 FROM merged WHERE end_w * 0.5::DOUBLE + 2 - start_w * 0.5::DOUBLE >= 2.5)"""


def _segments(spark, folder):
    return segments.segmented(views.class_scores(spark, folder), KEYS, 0.35, 0.21, 1, 2.0, 0.5, 2.5)


@Q(_RUNS + " SELECT video_id, event_type, start_w, end_w, round(peak, 6) AS peak, peak_w, n FROM runs")
def w06_hysteresis_runs(spark, folder):
    return islands.hysteresis_runs(views.class_scores(spark, folder), KEYS, 0.35, 0.21).select(*KEYS, "start_w", "end_w", r6("peak"), "peak_w", "n")


@Q(_MERGED + " SELECT video_id, event_type, start_w, end_w, round(peak, 6) AS peak, peak_w, n::BIGINT AS n FROM merged")
def w07_gap_merge(spark, folder):
    runs = islands.hysteresis_runs(views.class_scores(spark, folder), KEYS, 0.35, 0.21)
    return islands.gap_merged(runs, KEYS, 1).select(*KEYS, "start_w", "end_w", r6("peak"), "peak_w", "n")


@Q(_SEGMENTS + " SELECT video_id, event_type, start_sec, end_sec, peak_sec, round(confidence, 6) AS confidence, round(mean_confidence, 6) AS mean_confidence FROM seg")
def a09_segments(spark, folder):
    return _segments(spark, folder).select(*KEYS, "start_sec", "end_sec", "peak_sec", r6("confidence"), r6("mean_confidence"))


@Q(_SEGMENTS + " SELECT video_id, event_type, sum(end_sec - start_sec) AS total_sec, count(*) AS event_count, round(max(confidence), 6) AS peak_confidence FROM seg GROUP BY ALL")
def a10_class_summary(spark, folder):
    return segments.class_summary(_segments(spark, folder), KEYS).select(*KEYS, "total_sec", "event_count", r6("peak_confidence"))


@Q(_SEGMENTS + " SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, confidence DESC, event_type) AS rk, event_type, start_sec FROM seg")
def t01_event_order(spark, folder):
    rank = Window.partitionBy("video_id").orderBy("start_sec", F.col("confidence").desc(), "event_type")
    return _segments(spark, folder).withColumn("rk", F.row_number().over(rank).cast("long")).select("video_id", "rk", "event_type", "start_sec")


@Q(
    _SEGMENTS
    + """, cs AS (SELECT video_id, event_type, sum(end_sec - start_sec) AS total_sec, count(*) AS event_count FROM seg GROUP BY ALL)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY total_sec DESC, event_type) AS nth, event_type, round(total_sec, 6) AS total_s, event_count FROM cs"""
)
def t02_summary_order(spark, folder):
    rows = segments.ordered_summary(segments.class_summary(_segments(spark, folder), KEYS), "event_type")
    return rows.select("video_id", "nth", "event_type", r6("total_sec").alias("total_s"), "event_count")


@Q(
    f"WITH {S.EVENTS} SELECT video_id, pos, label, n > 20 AS truncated, row_number() OVER (PARTITION BY video_id ORDER BY \"start\", score DESC, pos) AS place FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY (category IN ('alarm', 'distress')) DESC, score DESC, pos) AS nth FROM ev) WHERE nth <= 20"
)
def t03_priority_cap(spark, folder):
    rows = views.interval_events(spark, folder).withColumn("is_safety", F.col("category").isin("alarm", "distress")).withColumn("confidence", F.col("score"))
    return segments.capped(rows, 20, ["pos"]).select("video_id", "pos", "label", "truncated", "place")


@Q(f'WITH {S.SCORES} SELECT video_id, w, nth AS rank, event_type AS "class", round(score::DOUBLE, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, w ORDER BY score DESC, event_type) AS nth FROM scores) WHERE nth <= 2')
def t04_topk(spark, folder):
    return segments.top_classes(views.class_scores(spark, folder).withColumnRenamed("event_type", "class"), 2)


@Q(f"WITH {S.SCORES}, a AS (SELECT *, CASE WHEN score >= 0.35::DOUBLE THEN 'on' ELSE 'off' END AS cls FROM scores), n AS (SELECT *, lag(cls) OVER v AS b, lead(cls) OVER v AS c FROM a WINDOW v AS (PARTITION BY video_id, event_type ORDER BY w)) SELECT video_id, event_type, w, CASE WHEN b = c AND cls <> b THEN b ELSE cls END AS smoothed FROM n")
def w11_mode_smoothing(spark, folder):
    rows = views.class_scores(spark, folder).withColumn("cls", F.when(F.col("score").cast("double") >= 0.35, "on").otherwise("off"))
    return islands.mode_smoothed(rows, KEYS, ["w"], "cls").select(*KEYS, "w", "smoothed")


@Q(
    f"""WITH {S.FRAMES}, m AS (SELECT *, sum(CASE WHEN event_type = b THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY idx) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY video_id ORDER BY idx) AS b FROM frames))
SELECT video_id, run::BIGINT AS run, event_type, min(t_ms) AS t0, max(t_ms) AS t1, max(raw) AS top FROM m GROUP BY ALL"""
)
def w10_run_lengths(spark, folder):
    rows = islands.run_lengths(views.frames(spark, folder), ["video_id"], ["idx"], "event_type")
    return rows.groupBy("video_id", "run", "event_type").agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1"), F.max("raw").alias("top"))


@Q(
    f"""WITH {S.FRAMES}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY video_id ORDER BY idx) AS b, sum(raw) OVER (PARTITION BY video_id ORDER BY idx) - raw AS before FROM frames)
SELECT video_id, idx, event_type, round(before, 4) AS offset_s FROM c WHERE b IS NOT NULL AND b <> event_type"""
)
def w13_state_changes(spark, folder):
    line = Window.partitionBy("video_id").orderBy("idx")
    rows = views.frames(spark, folder).withColumn("b", F.lag("event_type").over(line)).withColumn("before", F.sum("raw").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("raw"))
    return rows.filter("b is not null and b <> event_type").select("video_id", "idx", "event_type", F.round("before", 4).alias("offset_s"))


@Q(f"WITH {S.EVENTS} SELECT video_id, pos, label, category, severity, round(\"start\", 6) AS start_s, round(\"end\", 6) AS end_s FROM ev WHERE category <> 'human'")
def j01_safety_events(spark, folder):
    return views.interval_events(spark, folder).filter("category <> 'human'").select("video_id", "pos", "label", "category", "severity", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))


_CLUSTERS = f"""WITH {S.EVENTS}, cr AS (SELECT *, max("end") OVER (PARTITION BY video_id, category ORDER BY "start", pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev WHERE severity = 'critical'),
cl AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, category ORDER BY "start", pos) AS cluster FROM cr),
clusters AS (SELECT video_id, category, cluster, min("start") AS "start", max("end") AS "end", arg_max(label, [score::DOUBLE, pos::DOUBLE]) AS best, count(*) AS n FROM cl GROUP BY ALL)"""


@Q(_CLUSTERS + ' SELECT video_id, category, cluster::BIGINT AS cluster, round("start", 6) AS start_s, round("end", 6) AS end_s, best, n FROM clusters')
def w09_critical_clusters(spark, folder):
    return rules.critical_clusters(views.interval_events(spark, folder)).select("video_id", "category", "cluster", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "best", "n")


_SPANS = f"""WITH RECURSIVE {S.EVENTS}, al AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY "start", pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev WHERE category = 'alarm'),
sp AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY "start", pos) AS span FROM al),
spans AS (SELECT video_id, span, min("start") AS "start", max("end") AS "end", count(*) AS pieces FROM sp GROUP BY ALL)"""


@Q(_SPANS + ' SELECT video_id, span::BIGINT AS span, round("start", 6) AS start_s, round("end", 6) AS end_s, pieces FROM spans')
def w08_alarm_spans(spark, folder):
    return rules.alarm_spans(views.interval_events(spark, folder)).select("video_id", "span", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "pieces")


_ACTIVITY = (
    _SPANS
    + """, met AS (SELECT s.video_id, span, s."start" AS alarm, e.pos, greatest(e."start", s."start") AS a, least(e."end", s."start" + 86400) AS b FROM spans s JOIN ev e ON e.video_id = s.video_id AND e.category = 'machine' AND e."end" > s."start" AND e."start" < s."start" + 86400),
rc AS (SELECT *, max(b) OVER (PARTITION BY video_id, span ORDER BY a, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM met WHERE b > a),
bu AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, span ORDER BY a, pos) AS burst FROM rc),
un AS (SELECT video_id, span, alarm, burst, min(a) AS a, max(b) AS b FROM bu GROUP BY ALL),
activity AS (SELECT video_id, span, alarm, max(b) AS last_end, count(*) AS bursts, sum(b - a) AS total FROM un GROUP BY ALL)"""
)


@Q(_ACTIVITY + " SELECT video_id, span::BIGINT AS span, round(alarm, 6) AS alarm_s, round(last_end, 6) AS last_s FROM activity")
def j05_post_alarm(spark, folder):
    return rules.post_alarm_activity(views.interval_events(spark, folder), WINDOW).select("video_id", "span", F.round("alarm_start", 6).alias("alarm_s"), F.round("last_end", 6).alias("last_s"))


@Q(_ACTIVITY + " SELECT video_id, span::BIGINT AS span, bursts, round(total, 4) AS total_s FROM activity")
def a12_union_total(spark, folder):
    return rules.post_alarm_activity(views.interval_events(spark, folder), WINDOW).select("video_id", "span", "bursts", F.round("total", 4).alias("total_s"))


_PAIRS = """, pairs AS (SELECT v.video_id, v.pos AS v_pos, h.pos AS h_pos, greatest(v."start", h."start") AS "start", least(v."end", h."end") AS "end", h.category = 'distress' AS distress
 FROM ev v JOIN ev h ON v.video_id = h.video_id AND v.category = 'vehicle' AND h.category IN ('human', 'distress') AND v."start" < h."end" AND h."start" < v."end")"""


@Q(f"WITH {S.EVENTS}{_PAIRS}" + ' SELECT video_id, v_pos, h_pos, round("start", 6) AS start_s, round("end", 6) AS end_s FROM pairs')
def j04_overlap_pairs(spark, folder):
    return rules.overlap_pairs(views.interval_events(spark, folder), BUCKET).select("video_id", "v_pos", "h_pos", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))


_KEPT = """, ordered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY v_pos, h_pos) AS rn FROM pairs),
walk AS (SELECT video_id, rn, [\"start\"] AS kept, v_pos, h_pos, "start", "end", distress, true AS keep FROM ordered WHERE rn = 1 UNION ALL
SELECT o.video_id, o.rn, CASE WHEN len([k FOR k IN w.kept IF abs(k - o."start") < 1]) = 0 THEN list_append(w.kept, o."start") ELSE w.kept END, o.v_pos, o.h_pos, o."start", o."end", o.distress,
 len([k FOR k IN w.kept IF abs(k - o."start") < 1]) = 0 FROM walk w JOIN ordered o ON o.video_id = w.video_id AND o.rn = w.rn + 1),
kept AS (SELECT video_id, v_pos, h_pos, "start", "end", CASE WHEN distress THEN 'critical' ELSE 'warning' END AS severity FROM walk WHERE keep)"""


@Q(f"WITH RECURSIVE {S.EVENTS}{_PAIRS}{_KEPT}" + ' SELECT video_id, v_pos, h_pos, round("start", 6) AS start_s, severity FROM kept')
def g03_overlap_findings(spark, folder):
    return rules.vehicle_near_person(views.interval_events(spark, folder), BUCKET).select("video_id", "v_pos", "h_pos", F.round("start", 6).alias("start_s"), "severity")


@Q(
    _ACTIVITY
    + _CLUSTERS[_CLUSTERS.index(", cr AS") :]
    + _PAIRS
    + _KEPT
    + """ SELECT video_id, 'critical_sound' AS rule, 'critical' AS severity, round("start", 6) AS start_s, round("end", 6) AS end_s FROM clusters
UNION ALL SELECT video_id, 'post_alarm_activity', 'critical', round(alarm, 6), round(last_end, 6) FROM activity
UNION ALL SELECT video_id, 'vehicle_near_person', severity, round("start", 6), round("end", 6) FROM kept"""
)
def u01_findings(spark, folder):
    """The flagship: all safety findings of all recordings."""
    return rules.findings(views.interval_events(spark, folder), WINDOW, BUCKET).select("video_id", "rule", "severity", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))


@Q(
    f"""WITH {S.EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score::DOUBLE DESC, "start", label) AS nth, count(*) OVER (PARTITION BY video_id) AS n FROM ev),
m AS (SELECT *, CAST(floor("start") AS BIGINT) AS s, CAST(floor("end") AS BIGINT) AS e FROM r WHERE nth <= 12)
SELECT video_id, string_agg(CASE WHEN s // 60 < 10 THEN '0' ELSE '' END || (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') || '–' || CASE WHEN e // 60 < 10 THEN '0' ELSE '' END || (e // 60) || ':' || lpad((e % 60)::VARCHAR, 2, '0') || ' ' || label || ' (%' || round(score::DOUBLE * 100)::BIGINT || ')', '; ' ORDER BY "start", nth)
 || CASE WHEN max(n) > 12 THEN '; ' || (max(n) - 12) || ' more' ELSE '' END AS digest FROM m GROUP BY video_id"""
)
def t05_digest(spark, folder):
    rows = views.interval_events(spark, folder).select("video_id", "label", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), F.col("score").cast("double").alias("confidence"))
    return reports.audio_digest(rows, 12)


@Q(f"WITH {S.TRUTH}, m AS (SELECT g.video_id, g.t_ms, min(abs(p.t_ms - g.t_ms)) AS miss FROM gt g LEFT JOIN pred p USING (video_id) GROUP BY ALL) SELECT video_id, t_ms, miss, coalesce(miss <= {TOLERANCE}, false) AS covered FROM m")
def j07_coverage(spark, folder):
    return metrics.coverage(views.truth(spark, folder), views.predictions(spark, folder), TOLERANCE)


@Q(f"WITH {S.TRUTH} SELECT g.video_id, g.t_ms, arg_min(p.t_ms - g.t_ms, [abs(p.t_ms - g.t_ms), p.t_ms]) FILTER (WHERE abs(p.t_ms - g.t_ms) <= {TOLERANCE}) AS off FROM gt g LEFT JOIN pred p USING (video_id) GROUP BY ALL")
def j08_matching(spark, folder):
    return joins.nearest(views.truth(spark, folder), views.predictions(spark, folder), TOLERANCE).select("video_id", "t_ms", F.col("n_off").alias("off"))


@Q(f"WITH {S.TRUTH} SELECT p.video_id, p.t_ms FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.video_id = p.video_id AND abs(g.t_ms - p.t_ms) <= {TOLERANCE})")
def j09_false_cuts(spark, folder):
    return metrics.false_cuts(views.predictions(spark, folder), views.truth(spark, folder), TOLERANCE)


_METRICS = f"""WITH {S.TRUTH}, m AS (SELECT g.video_id, g.t_ms, min(abs(p.t_ms - g.t_ms)) AS miss FROM gt g LEFT JOIN pred p USING (video_id) GROUP BY ALL),
vm AS (SELECT video_id, count(*) AS total, count(*) FILTER (WHERE miss <= {TOLERANCE}) AS covered, max(miss) AS worst_miss, (sum(miss) FILTER (WHERE miss <= {TOLERANCE}) // nullif(count(*) FILTER (WHERE miss <= {TOLERANCE}), 0))::BIGINT AS mean_offset FROM m GROUP BY video_id)"""


@Q(_METRICS + " SELECT * FROM vm")
def a14_video_metrics(spark, folder):
    return metrics.video_metrics(views.truth(spark, folder), views.predictions(spark, folder), TOLERANCE)


@Q(_METRICS + " SELECT count(*) AS videos, round(coalesce(sum(covered)::DOUBLE / nullif(sum(total), 0), 1.0), 6) AS recall, CAST(floor(avg(mean_offset) FILTER (WHERE covered > 0)) AS BIGINT) AS mean_offset FROM vm")
def a16_corpus(spark, folder):
    rows = metrics.video_metrics(views.truth(spark, folder), views.predictions(spark, folder), TOLERANCE)
    return metrics.corpus_metrics(rows).select("videos", F.round("recall", 6).alias("recall"), "mean_offset")


@Q(_METRICS + " SELECT video_id, round(covered::DOUBLE / nullif(total, 0), 6) AS recall, coalesce(worst_miss > 86400000 * 1.05::DOUBLE, false) AS violated FROM vm")
def a15_recall(spark, folder):
    rows = metrics.video_metrics(views.truth(spark, folder), views.predictions(spark, folder), TOLERANCE)
    return rows.select("video_id", F.round(F.try_divide("covered", F.nullif("total", F.lit(0))), 6).alias("recall"), F.coalesce(F.col("worst_miss") > 86_400_000 * 1.05, F.lit(False)).alias("violated"))


@Q(
    _CLUSTERS
    + """, cf AS (SELECT *, CAST(floor("start") AS BIGINT) AS s, CAST(floor("end") AS BIGINT) AS e FROM cl)
SELECT video_id, category, cluster::BIGINT AS cluster, string_agg(label || ' ' || CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s // 60) % 60)::VARCHAR, 2, '0') ELSE CASE WHEN s // 60 < 10 THEN '0' ELSE '' END || (s // 60) END || ':' || lpad((s % 60)::VARCHAR, 2, '0')
 || '–' || CASE WHEN e >= 3600 THEN (e // 3600) || ':' || lpad(((e // 60) % 60)::VARCHAR, 2, '0') ELSE CASE WHEN e // 60 < 10 THEN '0' ELSE '' END || (e // 60) END || ':' || lpad((e % 60)::VARCHAR, 2, '0'), '; ' ORDER BY "start", pos) AS evidence FROM cf GROUP BY ALL"""
)
def a11_evidence(spark, folder):
    rows = rules.critical_clusters(views.interval_events(spark, folder))
    return rows.select("video_id", "category", "cluster", F.array_join("evidence", "; ").alias("evidence"))


@Q(
    Q.sql["u01_findings"].replace(" SELECT video_id, 'critical_sound' AS rule", ", every AS (SELECT video_id, 'critical_sound' AS rule", 1).replace('round("start", 6) AS start_s, round("end", 6) AS end_s FROM clusters', '"start", "end" FROM clusters', 1).replace("'critical', round(alarm, 6), round(last_end, 6) FROM activity", "'critical', alarm, last_end FROM activity", 1).replace('severity, round("start", 6), round("end", 6) FROM kept', 'severity, "start", "end" FROM kept', 1)
    + ') SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY "start", rule, "end", severity) AS nth, rule, severity, round("start", 6) AS start_s FROM every'
)
def t12_finding_order(spark, folder):
    """All findings of a recording in order of their start."""
    rows = rules.ordered_findings(views.interval_events(spark, folder), WINDOW, BUCKET)
    return rows.select("video_id", "nth", "rule", "severity", F.round("start", 6).alias("start_s"))
