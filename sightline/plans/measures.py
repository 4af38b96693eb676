"""Queries on raw frames, on how well a selection or a report does, and on what it costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sightline.functions import clock, media
from sightline.operators import metrics, profile, reports, rules
from sightline.plans import events as E
from sightline.plans import frames as P
from sightline.plans import sql as S
from sightline.plans.book import Book
from sightline.sources import views
from sightline.sources.folders import open_store, shared_folder
from sightline.sources.grey_frames import grey_frames
from sightline.sources.views import table

Q = Book()
r6 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
TOLERANCE = 21_600_000


@Q(
    P._SELECTED
    + f""", {P._VIDEOS}, tr AS (SELECT video_id, t_ms, event_id FROM frames WHERE event_type = 'purchase'), kw AS (SELECT * FROM walk WHERE keep),
g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY rn) AS gap FROM walk), k AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY rn) AS gap FROM kw),
b AS (SELECT video_id, 16 - count(*) FILTER (WHERE reason = 'scene_cut') AS left_over, count(*) FILTER (WHERE NOT keep) AS dropped, coalesce(max(gap), 0) AS wide FROM g GROUP BY video_id),
a AS (SELECT video_id, count(*) AS n, coalesce(max(gap), 0) AS own FROM k GROUP BY video_id),
m AS (SELECT t.video_id, t.event_id, min(abs(k.t_ms - t.t_ms)) AS miss FROM tr t LEFT JOIN kw k USING (video_id) GROUP BY ALL),
c AS (SELECT video_id, count(*) AS total, count(*) FILTER (WHERE miss <= {TOLERANCE}) AS covered, max(miss) FILTER (WHERE miss IS NOT NULL AND miss > {TOLERANCE}) AS worst, sum(miss) FILTER (WHERE miss <= {TOLERANCE}) AS off FROM m GROUP BY video_id),
u AS (SELECT f.video_id, count(*) AS cuts, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE t.video_id = f.video_id AND abs(t.t_ms - f.t_ms) <= {TOLERANCE})) AS bad FROM frames f WHERE event_type = 'error' GROUP BY f.video_id)
SELECT v.video_id, duration_ms, coalesce(total, 0) AS events_total, coalesce(covered, 0) AS events_covered, round(covered / nullif(total, 0)::DOUBLE, 6) AS recall, worst AS worst_miss_ms, coalesce(off // nullif(covered, 0), 0)::BIGINT AS mean_offset_ms, coalesce(a.n, 0) AS selected_frames, coalesce(dropped, 0) AS dropped_duplicates,
 n_frames AS source_frames, round(n_frames / greatest(coalesce(a.n, 0), 1)::DOUBLE, 6) AS reduction_ratio, coalesce(own, 0)::BIGINT AS max_gap_ms, coalesce(wide, 0)::BIGINT AS max_gap_before_dedup_ms, round(duration_ms / greatest(coalesce(left_over, 16), 1)::DOUBLE / 0.25::DOUBLE)::BIGINT AS gap_limit_ms,
 coalesce(wide > round(duration_ms / greatest(coalesce(left_over, 16), 1)::DOUBLE / 0.25::DOUBLE) * 1.05, false) AS gap_violated, coalesce(cuts, 0) AS scene_cuts, coalesce(bad, 0) AS false_scene_cuts
FROM videos v LEFT JOIN b USING (video_id) LEFT JOIN a USING (video_id) LEFT JOIN c USING (video_id) LEFT JOIN u USING (video_id)"""
)
def a14_selection_metrics(spark, folder):
    """Everything that is measured of a recording's selection: coverage, gaps and their limit, reduction, false cuts."""
    rows = views.fingerprinted_profile(spark, folder)
    videos = rows.groupBy("video_id").agg((F.max("t_ms") + 67).alias("duration_ms"), F.count("*").alias("source_frames"))
    out = metrics.selection_metrics(views.predictions(spark, folder), rows, videos, P.HOW, TOLERANCE)
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "reduction_ratio")})


_RUNS = """res AS (SELECT o_orderpriority AS variant, o_orderkey % 3 AS run, o_orderkey % 7 AS matched, o_orderstatus = 'P' AS error, o_orderkey % 5 AS produced, o_orderkey % 11 * 40 - 200 AS off, o_orderkey % 4 AS n_off, o_totalprice AS seconds, o_orderkey % 3 <> 1 AS valid, o_orderkey % 6 AS actions FROM orders)"""


@Q(
    f"""WITH {_RUNS}, rr AS (SELECT variant, run, sum(CASE WHEN error THEN 0 ELSE matched END) AS matched, count(*) FILTER (WHERE error) AS errors, count(*) AS results, sum(produced) AS produced, coalesce(sum(abs(off) * n_off) / nullif(sum(n_off), 0)::DOUBLE, 0) AS offs,
 coalesce(sum(seconds) FILTER (WHERE NOT error) / nullif(count(*) FILTER (WHERE NOT error), 0), 0) AS seconds, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE actions = 0) AS bare FROM res GROUP BY ALL)
SELECT variant, count(*) AS runs, round(avg(matched), 6) AS mean, min(matched)::BIGINT AS low, max(matched)::BIGINT AS high, (max(matched) - min(matched))::BIGINT AS spread, sum(errors)::BIGINT AS errors, sum(results)::BIGINT AS results, round(avg(produced), 6) AS produced, round(avg(offs), 6) AS mean_offset_ms, round(avg(seconds), 4) AS mean_seconds, sum(valid)::BIGINT AS valid, sum(bare)::BIGINT AS without_actions FROM rr GROUP BY variant"""
)
def a17_run_comparison(spark, folder):
    """Variants compared over repeated runs, with offsets (of either sign, several a result) and times without errors."""
    k = F.col("o_orderkey")
    off = F.array_repeat((k % 11 * 40 - 200).cast("long"), (k % 4).cast("int"))
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("variant"), (k % 3).alias("run"), (k % 7).alias("matched"), (F.col("o_orderstatus") == "P").alias("error"), (k % 5).alias("produced"), off.alias("offsets_ms"), F.col("o_totalprice").cast("double").alias("seconds"), (k % 3 != 1).alias("valid"), (k % 6).alias("actions")
    )
    return metrics.run_comparison(rows).withColumns({"mean": F.round("mean", 6), "produced": F.round("produced", 6), "mean_offset_ms": F.round("mean_offset_ms", 6), "mean_seconds": F.round("mean_seconds", 4)})


@Q("""WITH r AS (SELECT o_orderpriority AS truth, CASE WHEN o_orderkey % 4 = 0 THEN '5-LOW' ELSE o_orderpriority END AS predicted FROM orders), c(category) AS (VALUES ('1-URGENT'), ('5-LOW'), ('2-HIGH'), ('unheard of'))
SELECT category, count(truth) AS n, round(coalesce(count(*) FILTER (WHERE predicted = truth) / nullif(count(truth), 0)::DOUBLE, 0), 6) AS recall FROM c LEFT JOIN r ON truth = category GROUP BY category""")
def a21_category_recall(spark, folder):
    """The recall of each category, one of which never occurs."""
    rows = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("truth"), F.when(F.col("o_orderkey") % 4 == 0, "5-LOW").otherwise(F.col("o_orderpriority")).alias("predicted"))
    return metrics.category_recall(rows, ["1-URGENT", "5-LOW", "2-HIGH", "unheard of"]).select("category", "n", r6("recall"))


_SIZE = "CAST(greatest(1, floor({0} * least(1.0::DOUBLE, 960.0::DOUBLE / greatest(event_id % 2000 + 1, event_id % 900 + 1)) + 0.5)) AS BIGINT)"


@Q(
    f"""WITH e AS (SELECT event_id, CAST(ceil({_SIZE.format("(event_id % 2000 + 1)")} / 28.0) * ceil({_SIZE.format("(event_id % 900 + 1)")} / 28.0) AS BIGINT) AS per_frame, CAST(floor(event_id * 37 / 1000.0::DOUBLE * 25 + 0.5) AS BIGINT) AS source_frames, CAST(floor(value * 2 + 0.5) AS BIGINT) AS sent_frames FROM events)
SELECT *, per_frame * sent_frames AS frames_total, round(source_frames / greatest(sent_frames, 1)::DOUBLE, 6) AS ratio, source_frames * per_frame AS tokens_if_naive FROM e"""
)
def a30_reduction(spark, folder):
    """What sending a clip costs, and what sending all its frames would."""
    size = media.scaled_size(F.col("event_id") % 2000 + 1, F.col("event_id") % 900 + 1, 960)
    told = media.payload_estimate(size["width"], size["height"], F.col("event_id") * 37, F.lit(25.0), clock.service_frames(F.col("value")))
    return table(spark, folder, "events").select("event_id", told.alias("t")).select("event_id", "t.*").withColumn("ratio", F.round("ratio", 6))


@Q(
    E._CLUSTERS
    + """, told AS (SELECT c.video_id, c.category, c.cluster, c.best, c.start, c."end", max(l.score) AS top, string_agg(l.label || ' %' || CAST(round(l.score::DOUBLE * 100) AS BIGINT), ', ' ORDER BY l.start, l.pos) FILTER (WHERE l.label <> c.best) AS also FROM clusters c JOIN cl l USING (video_id, category, cluster) GROUP BY ALL)
SELECT video_id, category, cluster::BIGINT AS cluster, best || ' detected' AS title, best || ' %' || CAST(round(top::DOUBLE * 100) AS BIGINT) || '.' || coalesce(' Also taken for: ' || also || '.', '') AS told FROM told"""
)
def a11_findings(spark, folder):
    """What a finding of critical sounds says, apart from its clock times: the best label and the others with their scores."""
    rows = rules.critical_clusters(views.interval_events(spark, folder))
    return rows.select("video_id", "category", "cluster", "title", F.regexp_extract("detail", "(?s): (.*)", 1).alias("told"))


@Q("""WITH r AS (SELECT doc_id // 10 AS video_id, doc_id AS seq, CASE WHEN toxic = 1 THEN ['stop'] ELSE [] END AS actions FROM labels)
SELECT video_id, CASE WHEN bool_or(len(actions) > 0) THEN 'stop' ELSE 'review' END AS actions FROM r GROUP BY video_id""")
def a23_default_action(spark, folder):
    """Merged reports, some of which propose nothing at all."""
    rows = table(spark, folder, "labels").select(F.expr("doc_id div 10").alias("video_id"), F.col("doc_id").alias("seq"), F.lit("x").alias("summary"), F.lit("low").alias("risk"), F.when(F.col("toxic") == 1, F.array(F.lit("stop"))).otherwise(F.array().cast("array<string>")).alias("actions"))
    return reports.merged_reports(rows, "review").select("video_id", F.array_join("actions", ",").alias("actions"))


@Q("""SELECT doc_id AS video_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'low' WHEN doc_id % 3 = 1 THEN 'high' ELSE 'medium' END WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN doc_id % 5 = 0 THEN 'none told' ELSE lang END AS summary, CASE WHEN doc_id % 2 = 0 THEN 'look' ELSE source END AS actions FROM documents""")
def f36_completed_reports(spark, folder):
    """Reports with what they lack: a summary, an action, and a risk that comes from their events (none, high and low, or unclear)."""
    k = F.col("doc_id")
    event = lambda *levels: F.array(*[F.struct(F.lit(x).alias("event"), F.lit(x).alias("severity")) for x in levels])
    none = event("x").cast("array<struct<event:string,severity:string>>")
    events = F.when(k % 3 == 0, F.slice(none, 1, 0)).when(k % 3 == 1, event("Low", "KRİTİK", "high")).otherwise(event("düşük", "odd"))
    risk = F.when(k % 4 == 0, "").when(k % 4 == 1, "YÜKSEK").when(k % 4 == 2, "hm").otherwise("low risk")
    rows = table(spark, folder, "documents").select(k.alias("video_id"), F.when(k % 5 == 0, " ").otherwise(F.col("lang")).alias("summary"), risk.alias("risk"), events.alias("events"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("source")).alias("actions"))
    return reports.completed(rows, "none told", "look").select("video_id", "risk", "summary", F.array_join("actions", ",").alias("actions"))


@Q("""WITH s AS (SELECT event_id, greatest(value * 90 - 300, 0) AS v FROM events), c AS (SELECT event_id, v, CASE WHEN v >= 3600 THEN CAST(floor(v / 3600) AS BIGINT) || ':' ELSE '' END || lpad(CAST(floor(v / 60) % 60 AS BIGINT)::VARCHAR, 2, '0') || ':' || lpad(CAST(floor(v) % 60 AS BIGINT)::VARCHAR, 2, '0') AS head FROM s)
SELECT event_id, head AS plain, head || '.' || CAST(floor((v % 1) * 10) AS BIGINT) AS tenths FROM c""")
def f05_player_clock(spark, folder):
    sec = F.col("value") * 90 - 300
    return table(spark, folder, "events").select("event_id", clock.player_clock(sec).alias("plain"), clock.player_clock(sec, True).alias("tenths"))


#: Grey pictures of 8 by 8 pixels from embeddings of 64 numbers; 64 of them make a recording.
_PIXELS = "pix AS (SELECT vec_id, vec_id // 64 AS video_id, vec_id % 64 AS idx, [least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255)::INT FOR x IN embedding] AS px FROM embeddings)"


def _pictures(spark, folder):
    level = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    k = F.col("vec_id")
    hexes = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(level(x)), 2, "0")), "")
    return table(spark, folder, "embeddings").select(F.expr("vec_id div 64").alias("video_id"), (k % 64).alias("idx"), (k % 64 * 40).alias("t_ms"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(hexes).alias("data"))


_FEATURES = f"""{_PIXELS}, d AS (SELECT *, lag(px) OVER (PARTITION BY video_id ORDER BY idx) AS before FROM pix), f AS (SELECT *, CASE WHEN before IS NULL THEN [0 FOR i IN range(64)] ELSE [abs(px[i + 1] - before[i + 1]) FOR i IN range(64)] END AS diff FROM d)"""


@Q(
    f"""WITH {_FEATURES} SELECT video_id, idx, round((list_sum(diff) / (64 * 255.0::DOUBLE))::FLOAT::DOUBLE, 6) AS raw, round((list_max(diff) / 255.0::DOUBLE)::FLOAT::DOUBLE, 6) AS cell_peak,
 array_to_string([CASE WHEN k % 12 % 3 = 2 THEN 0 ELSE diff[(k // 12) * 8 + (k % 12) // 3 * 2 + (k % 12) % 3 + 1] END FOR k IN range(96)], ',') AS grid FROM f"""
)
def a01_frame_motion(spark, folder):
    """Motion between pictures: over all pixels, and by the cells of a grid of 12 by 8."""
    rows = media.frame_features(_pictures(spark, folder))
    return rows.select("video_id", "idx", r6("raw"), r6("cell_peak"), F.array_join("grid", ",").alias("grid"))


@Q(f"""WITH {_PIXELS} SELECT video_id, idx, array_to_string([CASE WHEN b % 8 > 0 AND px[b // 8 * 8 + b % 8] > px[b // 8 * 8 + b % 8 + 1] THEN 1 ELSE 0 END FOR b IN range(64)], '') AS bits FROM pix""")
def a03_difference_hash(spark, folder):
    """The bits of each picture's fingerprint, lowest first. Nine boxes over eight pixels: the first two look at the same one."""
    rows = media.frame_features(_pictures(spark, folder))
    return rows.select("video_id", "idx", F.reverse(F.lpad(F.bin("dhash"), 64, "0")).alias("bits"))


@Q(f"""WITH {_FEATURES}, r AS (SELECT video_id, (list_sum(diff) / (64 * 255.0::DOUBLE))::FLOAT AS raw, (list_max(diff) / 255.0::DOUBLE)::FLOAT AS cell FROM f), t AS (SELECT video_id, list_sort(list(raw))[CAST(floor((count(*) - 1) * 0.99 + 0.5) AS INT) + 1] AS top FROM r GROUP BY video_id),
s AS (SELECT r.*, CASE WHEN top > 0 THEN least(raw::DOUBLE / top, 1.0) ELSE 0 END::FLOAT AS score FROM r JOIN t USING (video_id))
SELECT video_id, count(*) AS samples, round(sum(score::DOUBLE), 4) AS total, round(max(score::DOUBLE), 6) AS peak, round(max(cell)::DOUBLE, 6) AS cell_peak FROM s GROUP BY video_id""")
def a07_frame_totals(spark, folder):
    """A recording's totals with the most that a cell of its pictures moved."""
    rows = profile.normalised(media.frame_features(_pictures(spark, folder))).withColumn("is_scene_cut", F.lit(False))
    return profile.totals(rows).select("video_id", "samples", F.round("total", 4).alias("total"), r6("peak"), r6("cell_peak"))


def _write_y4m(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        store, path = open_store(folder)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/{int(pdf['video_id'].iloc[0]):09d}.y4m") as out:
            out.write(b"YUV4MPEG2 W8 H8 F25:1 Cmono\n")
            for data in pdf["data"]:
                out.write(b"FRAME\n" + bytes(data))
        return pdf[["video_id"]].head(1)

    return run


@Q(f"WITH {_PIXELS} SELECT video_id, idx, idx * 40 AS t_ms, list_sum(px)::BIGINT AS light FROM pix WHERE idx * 40 >= 400 AND idx * 40 < 1600")
def s02_raw_frames(spark, folder):
    """Pictures written as raw recordings, a file each, and read again between two times: the filter is the source's."""
    out = shared_folder(spark, "raw")
    _pictures(spark, folder).groupBy("video_id").applyInPandas(_write_y4m(out), "video_id long").write.format("noop").mode("overwrite").save()
    rows = grey_frames(spark, out).filter("t_ms >= 400 and t_ms < 1600")
    return rows.select(F.regexp_extract("path", "([0-9]+).y4m", 1).cast("long").alias("video_id"), "idx", "t_ms", F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(F.hex("data"), i * 2 + 1, F.lit(2)), 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("light"))
