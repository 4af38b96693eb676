"""Queries on scalar functions, texts, model answers, repeated runs and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import clock, media, text
from sightline.operators import metrics, reports
from sightline.plans import sql as S
from sightline.plans.book import Book
from sightline.sources import views

Q = Book()
_TWO = "CASE WHEN {0} < 10 THEN '0' ELSE '' END || ({0})"


def _clock(hours: str, total: str) -> str:
    mm = _TWO.format(f"({total} // 60)")
    return f"CASE WHEN {total} >= 3600 THEN {hours} || ':' || lpad((({total} // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad(({total} % 60)::VARCHAR, 2, '0') ELSE {mm} || ':' || lpad(({total} % 60)::VARCHAR, 2, '0') END"


@Q(
    f"""WITH {S.FRAMES}, s AS (SELECT video_id, idx, t_ms, t_ms // 1000 AS t FROM frames)
SELECT video_id, idx, {_clock(_TWO.format('(t // 3600)'), 't')} AS report, {_clock('(t // 3600)::VARCHAR', 't')} AS finding,
 {_TWO.format('(t // 60)')} || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS minutes,
 {_TWO.format('(t_ms // 60000)')} || ':' || lpad((t % 60)::VARCHAR, 2, '0') || '.' || ((t_ms // 100) % 10) AS tenth FROM s"""
)
def f01_timestamps(spark, folder):
    ms, sec = F.col("t_ms"), F.col("t_ms") / 1000.0
    return views.frames(spark, folder).select("video_id", "idx", clock.report_clock(ms).alias("report"), clock.finding_clock(sec).alias("finding"), clock.minute_clock(sec).alias("minutes"), clock.tenth_clock(ms).alias("tenth"))


@Q(
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 90) || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') WHEN 1 THEN ' 1 : ' || (event_id % 60) || ' : 07.9' WHEN 2 THEN 'soon' WHEN 3 THEN '' ELSE (event_id % 7) || ':xx' END AS txt, value FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN ((event_id % 90) * 60 + event_id % 60) * 1000 WHEN 1 THEN (3600 + (event_id % 60) * 60 + 7) * 1000 END AS ms,
 coalesce(CASE event_id % 5 WHEN 0 THEN ((event_id % 90) * 60 + event_id % 60) * 1000 WHEN 1 THEN (3600 + (event_id % 60) * 60 + 7) * 1000 END, CASE WHEN event_id % 2 = 0 THEN event_id END, 0) AS preferred FROM t"""
)
def f06_parse_time(spark, folder):
    e = views.table(spark, folder, "events").select("event_id")
    k, s = F.col("event_id") % 5, lambda x: x.cast("string")
    txt = (
        F.when(k == 0, F.concat(s(F.col("event_id") % 90), F.lit(":"), F.lpad(s(F.col("event_id") % 60), 2, "0")))
        .when(k == 1, F.concat(F.lit(" 1 : "), s(F.col("event_id") % 60), F.lit(" : 07.9")))
        .when(k == 2, "soon")
        .when(k == 3, "")
        .otherwise(F.concat(s(F.col("event_id") % 7), F.lit(":xx")))
    )
    ms = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    return e.withColumn("txt", txt).select("event_id", clock.parse_clock(F.col("txt")).alias("ms"), reports.event_time(F.col("txt"), ms).alias("preferred"))


@Q(
    """WITH c AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS ms, event_id AS t0, event_id + 5000 AS t1, CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 2.5 END::DOUBLE AS scale FROM events)
SELECT event_id, CASE WHEN scale <= 0 THEN t0 + ms ELSE least(t0 + CAST(floor(ms / scale + 0.5) AS BIGINT), t1) END AS source_ms, greatest(1.0, coalesce((event_id % 50) / 2.0::DOUBLE / nullif(ms / 1000.0::DOUBLE, 0), 1.0)) > 1.01 AS slow FROM c"""
)
def f08_rebase(spark, folder):
    e = views.table(spark, folder, "events").withColumn("ms", F.floor(F.col("value") * 100)).withColumn("scale", F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, 1.0).otherwise(2.5))
    return e.select("event_id", clock.clip_to_source(F.col("ms"), F.col("event_id"), F.col("event_id") + 5000, F.col("scale")).alias("source_ms"), (clock.slow_motion(F.col("event_id") % 50, F.col("ms")) > 1.01).alias("slow"))


@Q("SELECT event_id, CAST(floor(event_id * 1000.0::DOUBLE / 15 + 0.5) AS BIGINT) AS t_ms, CAST(floor(value * 2 + 0.5) AS BIGINT) AS service_frames, value * 2 <= 520 AS fits FROM events")
def f10_frame_times(spark, folder):
    e = views.table(spark, folder, "events")
    return e.select("event_id", clock.frame_time(F.col("event_id"), F.lit(15.0)).alias("t_ms"), clock.service_frames(F.col("value")).alias("service_frames"), (F.col("value") * 2 <= 520).alias("fits"))


@Q("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 3 THEN 'high' WHEN 4 THEN 'low' ELSE 'medium' END AS level, CASE event_id % 6 WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS rank FROM events")
def f15_severity(spark, folder):
    k = F.col("event_id") % 6
    said = F.when(k == 0, " LOW-ish").when(k == 1, "Yüksek").when(k == 2, "High!").when(k == 3, "CRITICAL risk").when(k == 4, "düşük").otherwise("moderate")
    level = text.severity_of(said)
    return views.table(spark, folder, "events").select("event_id", level.alias("level"), text.severity_rank(level).alias("rank"))


@Q(
    """WITH s AS (SELECT doc_id, '  --- a-b ---' || chr(13) || chr(10) || coalesce(text, '') || chr(10) AS x FROM documents), c AS (SELECT doc_id, CASE WHEN length(x) > 2000 THEN substring(x, 1, 2000) || ' … (kırpıldı)' ELSE x END AS x FROM s)
SELECT doc_id, md5(array_to_string([CASE WHEN starts_with(ltrim(s, ' '), '---') THEN '[?] ' || replace(s, '---', '- - -') ELSE s END FOR s IN string_split(replace(regexp_replace(x, '\r?\n$', ''), chr(13) || chr(10), chr(10)), chr(10))], chr(10))) AS digest FROM c"""
)
def f22_sanitize(spark, folder):
    said = text.untrusted(F.concat(F.lit("  --- a-b ---\r\n"), F.coalesce("text", F.lit("")), F.lit("\n")))
    return views.table(spark, folder, "documents").select("doc_id", F.md5(said).alias("digest"))


@Q("SELECT doc_id, substring(sha256(lang || chr(30) || text), 1, 16) AS digest FROM documents")
def a29_hash(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", text.content_hash(F.col("lang"), F.col("text")).alias("digest"))


@Q("""SELECT doc_id, 'in ' || lang || ': ' || n_chars || ' of ' || source AS filled, list_sort(list_distinct(['lang', 'n', 'source'])) = ['lang', 'n', 'source'] AS complete FROM documents""")
def f24_template(spark, folder):
    template = F.lit("in {lang}: {n} of {source}")
    filled = text.fill(template, {"lang": F.col("lang"), "n": F.col("n_chars").cast("string"), "source": F.col("source")})
    complete = F.array_sort(text.placeholders(template)) == F.array(F.lit("lang"), F.lit("n"), F.lit("source"))
    return views.table(spark, folder, "documents").select("doc_id", filled.alias("filled"), complete.alias("complete"))


@Q("SELECT event_id, 'frames/' || user_id || '/' || lpad((event_id * 37)::VARCHAR, 9, '0') || '.jpg' AS key, regexp_full_match(event_type || '-' || event_id, '[A-Za-z0-9_-]{1,128}') AS safe, regexp_replace(event_type || ' é' || event_id, '[^A-Za-z0-9._-]', '_', 'g') AS file FROM events")
def f27_keys(spark, folder):
    name = F.concat(F.col("event_type"), F.lit("-"), F.col("event_id").cast("string"))
    file = text.safe_file_name(F.concat(F.lit("a/b/"), F.col("event_type"), F.lit(" é"), F.col("event_id").cast("string")))
    return views.table(spark, folder, "events").select("event_id", text.frame_key(F.col("user_id"), F.col("event_id") * 37).alias("key"), text.is_safe_id(name).alias("safe"), file.alias("file"))


@Q(
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'not_editable' WHEN 2 THEN 'empty' WHEN 3 THEN 'too_long' WHEN 4 THEN 'placeholder' WHEN 5 THEN 'delimiter' END AS error FROM events"""
)
def p13_edit_errors(spark, folder):
    """Edits of prompt fragments; a line of dashes is none of the delimiters."""
    k = F.col("event_id") % 8
    said = F.when(k == 2, "  ").when(k == 3, F.repeat(F.lit("x"), 9000)).when(k == 4, "hello {nobody}").when(k == 5, f"a\n{text.DELIMITERS[1]}\nb").when(k == 6, "a\n---\n- b").otherwise("fine {name}")
    error = text.edit_error(said, k != 0, k != 1, F.array(F.lit("name")))
    return views.table(spark, folder, "events").select("event_id", error.alias("error"))


@Q(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'zoom' WHEN 1 THEN 'report' WHEN 2 THEN 'error' WHEN 3 THEN 'report' ELSE 'error' END AS kind,
 CASE event_id % 5 WHEN 1 THEN event_type WHEN 3 THEN 'wrapped' END AS summary FROM events"""
)
def f20_decisions(spark, folder):
    k = F.col("event_id") % 5
    said = (
        F.when(k == 0, 'sure: {"zoom": {"t0": 1, "t1": 2.5}} ok')
        .when(k == 1, F.concat(F.lit('```json\n{"summary": "'), F.col("event_type"), F.lit('", "events": [{"event": "x", "time": "00:10"}]}\n```')))
        .when(k == 2, '{"zoom": {"t0": 5, "t1": 2}}')
        .when(k == 3, '{"arguments": "{\\"summary\\": \\"wrapped\\"}"}')
        .otherwise("no answer")
    )
    return reports.parsed_answers(views.table(spark, folder, "events").select("event_id", said.alias("text"))).select("event_id", "kind", F.when(F.col("kind") == "report", F.col("answer.summary")).alias("summary"))


_RISK = "CASE quality + 2 * toxic WHEN 1 THEN 'low' WHEN 0 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END"


@Q(
    f"""WITH r AS (SELECT doc_id // 10 AS video_id, doc_id AS seq, CASE WHEN quality = 1 THEN 's' || doc_id ELSE ' ' END AS summary, {_RISK} AS risk, CASE WHEN toxic = 1 THEN ['stop', 'call'] ELSE ['watch'] END AS actions FROM labels)
SELECT video_id, coalesce(string_agg(summary, ' ' ORDER BY seq) FILTER (WHERE trim(summary) <> ''), '') AS summary,
 arg_max(risk, CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) AS risk,
 CASE WHEN bool_or(actions[1] = 'stop') AND bool_or(actions[1] = 'watch') THEN CASE WHEN arg_min(actions[1], seq) = 'stop' THEN 'stop,call,watch' ELSE 'watch,stop,call' END WHEN bool_or(actions[1] = 'stop') THEN 'stop,call' ELSE 'watch' END AS actions
FROM r GROUP BY video_id"""
)
def a22_merged_reports(spark, folder):
    k = F.col("quality") + 2 * F.col("toxic")
    rows = views.table(spark, folder, "labels").select(
        F.expr("doc_id div 10").alias("video_id"),
        F.col("doc_id").alias("seq"),
        F.when(F.col("quality") == 1, F.concat(F.lit("s"), F.col("doc_id").cast("string"))).otherwise(" ").alias("summary"),
        F.when(k == 1, "low").when(k == 0, "medium").when(k == 3, "high").otherwise("critical").alias("risk"),
        F.when(F.col("toxic") == 1, F.array(F.lit("stop"), F.lit("call"))).otherwise(F.array(F.lit("watch"))).alias("actions"),
    )
    return reports.merged_reports(rows).withColumn("actions", F.array_join("actions", ","))


_RESULTS = "res AS (SELECT o_orderpriority AS variant, o_orderkey % 3 AS run, 'v' || (o_custkey % 50) AS name, o_orderkey % 7 AS matched, o_orderstatus = 'P' AS error FROM orders)"
_STATS = f"WITH {_RESULTS}, rr AS (SELECT variant, run, sum(CASE WHEN error THEN 0 ELSE matched END) AS matched, count(*) FILTER (WHERE error) AS errors FROM res GROUP BY ALL), st AS (SELECT variant, count(*) AS runs, round(avg(matched), 6) AS mean, min(matched)::BIGINT AS low, max(matched)::BIGINT AS high, (max(matched) - min(matched))::BIGINT AS spread, sum(errors)::BIGINT AS errors FROM rr GROUP BY variant)"


def _results(spark, folder):
    return views.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("variant"), (F.col("o_orderkey") % 3).alias("run"), F.concat(F.lit("v"), (F.col("o_custkey") % 50).cast("string")).alias("name"), (F.col("o_orderkey") % 7).alias("matched"), (F.col("o_orderstatus") == "P").alias("error"))


@Q(_STATS + " SELECT * FROM st")
def a17_run_stats(spark, folder):
    return metrics.run_statistics(_results(spark, folder)).withColumn("mean", F.round("mean", 6))


@Q(_STATS + ", b AS (SELECT max(spread) AS band, max(mean) FILTER (WHERE variant = '5-LOW') AS base FROM st) SELECT variant, band, round(mean - base, 4) AS delta, abs(mean - base) > band AS significant FROM st, b")
def a18_noise_band(spark, folder):
    return metrics.noise_band(metrics.run_statistics(_results(spark, folder)), "5-LOW").withColumn("delta", F.round("delta", 4))


@Q(f"WITH {_RESULTS} SELECT name, CASE WHEN count(*) FILTER (WHERE error) = count(*) THEN 'always_error' WHEN min(CASE WHEN error THEN -1 ELSE matched END) = max(CASE WHEN error THEN -1 ELSE matched END) THEN 'stable' ELSE 'volatile' END AS stability FROM res GROUP BY name")
def a19_stability(spark, folder):
    return metrics.stability(_results(spark, folder))


@Q(f"WITH {_RESULTS} SELECT run, variant, count(*) AS produced FROM res WHERE matched = 0 AND NOT error GROUP BY ALL")
def a20_false_alarms(spark, folder):
    return _results(spark, folder).filter("matched = 0 and not error").groupBy("run", "variant").agg(F.count("*").alias("produced"))


@Q("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def a21_confusion(spark, folder):
    return views.table(spark, folder, "labels").groupBy(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")).agg(F.count("*").alias("n"))


@Q("SELECT count(*) AS n, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0)::DOUBLE, 6) AS recall, round(count(*) FILTER (WHERE quality <> 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality <> 1), 0)::DOUBLE, 6) AS fpr, round(count(*) FILTER (WHERE (quality = 1) = (toxic = 1)) / count(*)::DOUBLE, 6) AS accuracy FROM labels")
def a21_binary_metrics(spark, folder):
    rows = metrics.binary_metrics(views.table(spark, folder, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")))
    return rows.select("n", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", "accuracy")])


@Q("SELECT lang, count(*) AS n, sum(coalesce(n_chars, 0))::BIGINT AS total, count(n_chars) AS known FROM documents GROUP BY lang")
def a25_totals(spark, folder):
    return views.table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("total"), F.count("n_chars").alias("known"))


@Q(
    f"""WITH {S.FRAMES}, b AS (SELECT video_id, CAST(floor(raw / 20) AS BIGINT) AS k, count(*) AS n FROM frames GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY k) AS upto, sum(n) OVER (PARTITION BY video_id) AS total FROM b)
SELECT video_id, round(min(CASE WHEN upto >= 0.95::DOUBLE * total THEN k * 20 + 20 * (0.95::DOUBLE * total - (upto - n)) / n END), 6) AS p95 FROM c GROUP BY video_id"""
)
def a28_quantile(spark, folder):
    """A quantile from histogram buckets, linear within the bucket that holds it."""
    from pyspark.sql import Window

    b = views.frames(spark, folder).groupBy("video_id", F.floor(F.col("raw") / 20).alias("k")).agg(F.count("*").alias("n"))
    line = Window.partitionBy("video_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    c = b.withColumn("upto", F.sum("n").over(line)).withColumn("total", F.sum("n").over(Window.partitionBy("video_id")))
    inside = F.col("k") * 20 + 20 * (0.95 * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
    return c.groupBy("video_id").agg(F.round(F.min(F.when(F.col("upto") >= 0.95 * F.col("total"), inside)), 6).alias("p95"))


@Q("SELECT event_id, CAST(ceil((event_id % 2000 + 1) / 28.0) * ceil((event_id % 900 + 1) / 28.0) AS BIGINT) AS tokens, greatest(1, CAST(floor((event_id % 2000 + 1) * least(1.0::DOUBLE, 960.0::DOUBLE / greatest(event_id % 2000 + 1, event_id % 900 + 1)) + 0.5) AS BIGINT)) AS width, greatest(1, CAST(floor((event_id % 900 + 1) * least(1.0::DOUBLE, 960.0::DOUBLE / greatest(event_id % 2000 + 1, event_id % 900 + 1)) + 0.5) AS BIGINT)) AS height FROM events")
def a30_payload_size(spark, folder):
    """Image tokens of 28 pixel tiles, and a width scaled so that the longest side is at most 960."""
    w, h = F.col("event_id") % 2000 + 1, F.col("event_id") % 900 + 1
    return views.table(spark, folder, "events").select("event_id", media.image_tokens(w, h).alias("tokens"), media.scaled_size(w, h, 960)["width"].alias("width"), media.scaled_size(w, h, 960)["height"].alias("height"))
