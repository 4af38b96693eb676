"""Queries on file sources and sinks: files are written from the tables and read back by the sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import checks
from sightline.operators import reports
from sightline.plans import tools
from sightline.plans.book import Book
from sightline.sources import files, views
from sightline.sources.folders import shared_folder
from sightline.sources.views import table

Q = Book()


@Q("SELECT o_custkey AS c_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))::BIGINT AS place FROM orders")
def t06_newest_first(spark, folder):
    """Each customer's catalog of orders, newest first."""
    newest = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.row_number().over(newest).cast("long").alias("place"))


_PROBES = """p AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN '0/0' WHEN 2 THEN '25/1' ELSE 'x' END AS av, CASE WHEN o_orderkey % 3 = 0 THEN '24/1' ELSE '0/1' END AS rr, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 700 / 1000.0::DOUBLE END AS fd, o_orderkey % 900 / 1000.0::DOUBLE AS sd FROM orders),
f AS (SELECT k, coalesce(CASE av WHEN '30000/1001' THEN 30000 / 1001.0::DOUBLE WHEN '25/1' THEN 25.0 END, CASE rr WHEN '24/1' THEN 24.0 END) AS fps, round(coalesce(fd, sd) * 1000)::BIGINT AS duration_ms, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE 'av1' END AS codec FROM p)"""


def _probes(spark, folder):
    k = F.col("o_orderkey")
    average = F.when(k % 4 == 0, "30000/1001").when(k % 4 == 1, "0/0").when(k % 4 == 2, "25/1").otherwise("x")
    stream = F.struct(average.alias("avg_frame_rate"), F.when(k % 3 == 0, "24/1").otherwise("0/1").alias("r_frame_rate"), (k % 900 / 1000).cast("string").alias("duration"), F.when(k % 7 != 0, "av1").alias("codec_name"))
    said = F.to_json(F.struct(F.array(stream).alias("streams"), F.struct(F.when(k % 5 != 0, (k % 700 / 1000).cast("string")).alias("duration")).alias("format")))
    return table(spark, folder, "orders").select(k.alias("k"), F.concat(F.lit("raw/"), k.cast("string")).alias("object_key"), files.probe_fields(said).alias("p")).select("k", "object_key", "p.*")


@Q(f"WITH {_PROBES} SELECT k, round(fps, 6) AS fps, duration_ms, codec FROM f")
def s01_probe_fields(spark, folder):
    """What a container's probe says: rates as fractions, some of them 0 or no number, and lengths of two kinds."""
    return _probes(spark, folder).select("k", F.round("fps", 6).alias("fps"), "duration_ms", "codec")


@Q(f"WITH {_PROBES} SELECT k, CASE WHEN fps IS NULL THEN 'no frame rate' WHEN duration_ms <= 0 THEN 'no duration' WHEN duration_ms < 200 THEN 'too short' END AS reason FROM f")
def u05_gate(spark, folder):
    """Recordings parted in two by the ingest gate: those that are taken, and the others with their reason."""
    taken, refused = files.ingest_gate(_probes(spark, folder))
    return taken.select("k", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("k", "reason"))


@Q(f"WITH {_PROBES} SELECT k, true AS transcode FROM f")
def k06_transcode(spark, folder):
    return _probes(spark, folder).select("k", checks.needs_transcode(F.col("codec")).alias("transcode"))


@Q("""WITH r AS (SELECT event_id AS video_id, event_id % 50 * 100 AS t0, event_id % 50 * 100 + (event_id % 41 - 3) * 100 AS t1 FROM events), c AS (SELECT *, t1 - t0 AS ms FROM r WHERE t1 > t0), s AS (SELECT *, greatest(1.0::DOUBLE, 16.0::DOUBLE / (ms / 1000.0::DOUBLE)) AS k FROM c)
SELECT video_id, t0, t1, round(k, 6) AS time_scale, CAST(floor(ms / 1000.0::DOUBLE * k * 2 + 0.5) AS BIGINT) AS service_frames, round(2 * k, 6) AS effective_fps FROM s""")
def k05_clip_counters(spark, folder):
    """Clips stretched so that a service that looks twice a second sees enough of them; empty ranges give none."""
    k = F.col("event_id")
    ranges = table(spark, folder, "events").select(k.alias("video_id"), (k % 50 * 100).alias("t0"), (k % 50 * 100 + (k % 41 - 3) * 100).alias("t1"))
    return tools.clip_range(ranges).select("video_id", "t0", "t1", F.round("time_scale", 6).alias("time_scale"), "service_frames", F.round("effective_fps", 6).alias("effective_fps"))


@Q("SELECT o_orderpriority AS variant, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def k13_csv_result(spark, folder):
    """A small result written as CSV with a header, and read again."""
    out = shared_folder(spark, "csv")
    files.write_report(table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("variant")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), out)
    return spark.read.schema("variant string, n long, total double").option("header", True).csv(out)


@Q("SELECT c_custkey::VARCHAR AS id, c_name AS original_name, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC))::BIGINT AS place FROM customer WHERE c_custkey % 10 <> 0")
def s13_catalog_scan(spark, folder):
    """A catalog of one JSON record a line, a tenth of which can't be read: the others, newest first in each nation's part."""
    out = shared_folder(spark, "catalog")
    own = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("original_name"), F.col("c_nationkey").cast("string").alias("object_key"), F.timestamp_seconds("c_custkey").alias("uploaded_at")))
    table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("{"), own)).otherwise(own).alias("value")).write.text(out)
    rows = files.catalog(spark, out, one_a_file=False)
    newest = Window.partitionBy("object_key").orderBy(F.col("uploaded_at").desc(), "id")
    return rows.select("id", "original_name", F.row_number().over(newest).cast("long").alias("place"))


@Q("SELECT n_nationkey::INTEGER AS class_index, n_name AS display_name, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS display_name_tr, CASE WHEN n_nationkey % 5 = 0 THEN 'critical' END AS severity FROM nation")
def s08_labels(spark, folder):
    """Class labels and translations as CSV files, with names in quotes; what has no translation keeps its name."""
    out = shared_folder(spark, "labels")
    nations = table(spark, folder, "nation")
    nations.select(F.col("n_nationkey").cast("int").alias("class_index"), F.concat(F.lit("/m/"), F.col("n_regionkey").cast("string")).alias("mid"), F.col("n_name").alias("display_name")).coalesce(1).write.option("header", True).option("quoteAll", True).csv(f"{out}/labels")
    translations = nations.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("display_name"), F.lower("n_name").alias("display_name_tr"))
    safety = nations.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("label"), F.lit("critical").alias("severity"), F.lit("alarm").alias("category"))
    rows = files.translated_labels(files.class_labels(spark, f"{out}/labels", nations.count()), translations, safety)
    return rows.select("class_index", "display_name", "display_name_tr", "severity")


@Q("""WITH l AS (SELECT c_nationkey AS v, c_custkey AS t FROM customer) SELECT 'v' || v AS video, 1000 + v AS duration_ms, t AS t_ms, 'event ' || t AS event FROM l""")
def s10_ground_truth(spark, folder):
    """Labelled recordings from JSON files, a nation's customers as the events of one; other files are not read."""
    out = shared_folder(spark, "truth")
    event = F.struct(F.col("c_custkey").alias("t_ms"), F.concat(F.lit("event "), F.col("c_custkey").cast("string")).alias("event"))
    rows = table(spark, folder, "customer").groupBy(F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("video"), (1000 + F.col("c_nationkey")).cast("long").alias("duration_ms")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    # a record a file, as the source reads them
    rows.repartition(200, "video").write.option("maxRecordsPerFile", 1).json(out)
    return files.ground_truth(spark, out).select("video", "duration_ms", "t_ms", "event")


_RESULTS = "res AS (SELECT o_orderpriority AS variant, o_orderkey % 3 AS run, o_custkey % 50 AS video, sum(o_orderkey % 7) AS matched, sum(o_orderkey % 9) AS truth, sum(o_orderkey % 5) AS produced, bool_and(o_orderstatus = 'P') AS error FROM orders GROUP BY ALL)"


@Q(
    f"""WITH {_RESULTS}, r AS (SELECT variant, run, sum(CASE WHEN error THEN 0 ELSE matched END) AS matched, sum(truth) AS truth, sum(produced) AS produced, count(*) FILTER (WHERE error) AS errors, count(*) AS n FROM res GROUP BY ALL),
a AS (SELECT variant, 'compared' AS section, '| `' || variant || '` | ' || CAST(round(avg(matched), 1) AS DECIMAL(18,1)) || '/' || arg_min(truth, run) || ' | ' || min(matched) || '–' || max(matched) || ' | ' || sum(errors) || '/' || sum(n) || ' | ' || CAST(round(avg(produced), 1) AS DECIMAL(18,1)) || ' |' AS line FROM r GROUP BY variant),
v AS (SELECT variant, video, count(*) FILTER (WHERE error) = count(*) AS never, min(CASE WHEN error THEN -1 ELSE matched END) = max(CASE WHEN error THEN -1 ELSE matched END) AS same, min(matched) FILTER (WHERE NOT error) AS lo, max(matched) FILTER (WHERE NOT error) AS hi FROM res GROUP BY ALL),
k(kind, word) AS (VALUES ('stable', 'stable'), ('volatile', 'volatile'), ('failing', 'always an error')),
s AS (SELECT variant, video, CASE WHEN never THEN 'failing' WHEN same THEN 'stable' ELSE 'volatile' END AS kind, 'v' || video || CASE WHEN never OR same THEN '' ELSE ' (' || lo || '–' || hi || ')' END AS told FROM v),
b AS (SELECT variant, 'stability', '- ' || word || ' (' || count(video) || '): ' || coalesce(string_agg(told, ', ' ORDER BY 'v' || video), 'none') FROM (SELECT DISTINCT variant FROM res) JOIN k ON true LEFT JOIN s USING (variant, kind) GROUP BY variant, word),
d AS (SELECT variant, 'runs', '| v' || video || ' | ' || string_agg(CASE WHEN error THEN '**error**' ELSE matched || '/' || truth || ' (' || produced || ')' END, ' | ' ORDER BY run) || ' |' FROM res GROUP BY variant, video)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d UNION ALL SELECT variant, 'false_alarms', '| v' || video || ' | ' || string_agg(CASE WHEN error THEN 'error' ELSE produced::VARCHAR END, ', ' ORDER BY run) || ' |' FROM res GROUP BY variant, video HAVING arg_min(truth, run) = 0"""
)
def k12_report(spark, folder):
    """The lines of a report on repeated runs: variants compared, how stable each recording is, and each run."""
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("variant"), (k % 3).alias("run"), F.concat(F.lit("v"), (F.col("o_custkey") % 50).cast("string")).alias("video")).agg(F.sum(k % 7).alias("matched"), F.sum(k % 9).alias("truth"), F.sum(k % 5).alias("produced"), F.bool_and(F.col("o_orderstatus") == "P").alias("error"))
    return reports.report_lines(rows).select("variant", "section", "line")
