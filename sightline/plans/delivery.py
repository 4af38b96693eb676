"""Queries on what leaves the engine: delivered reports, result documents, display names, appends and cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import clock
from sightline.operators import joins, metrics, reports
from sightline.plans import sql as S
from sightline.plans.book import Book
from sightline.sources import views
from sightline.sources.views import table

Q = Book()


def _reports(spark, folder):
    """(video_id, summary, events, risk, actions): a recording's alarms as a report with inner fields."""
    e = views.interval_events(spark, folder).filter("severity = 'critical'")
    own = F.struct(F.col("pos"), F.round(F.col("start") * 1000).cast("long").alias("t_ms"), clock.report_clock(F.round(F.col("start") * 1000)).alias("time"), F.col("label").alias("event"), "severity")
    rows = e.groupBy("video_id").agg(F.array_sort(F.collect_list(own)).alias("events"))
    return rows.select("video_id", F.concat(F.size("events").cast("string"), F.lit(" alarms")).alias("summary"), "events", F.lit("high").alias("risk"), F.array(F.lit("call")).alias("actions"))


_CRITICAL = f"""WITH {S.EVENTS}, cr AS (SELECT video_id, pos, label, CAST(floor("start" * 1000 + 0.5) AS BIGINT) AS ms FROM ev WHERE severity = 'critical'), c AS (SELECT *, ms // 1000 AS s FROM cr)"""
_CLOCK = "CASE WHEN {0} >= 3600 THEN CASE WHEN {0} < 36000 THEN '0' ELSE '' END || ({0} // 3600) || ':' || lpad((({0} // 60) % 60)::VARCHAR, 2, '0') ELSE lpad(({0} // 60)::VARCHAR, 2, '0') END || ':' || lpad(({0} % 60)::VARCHAR, 2, '0')"


@Q(_CRITICAL + f" SELECT video_id, count(*) || ' alarms' AS summary, string_agg({_CLOCK.format('s')} || ' ' || label, '; ' ORDER BY pos) AS events, 'high' AS risk, 'call' AS actions FROM c GROUP BY video_id")
def p04_delivered(spark, folder):
    """Reports in the form that is delivered; the only fields of an event are its time and what happened."""
    rows = reports.delivered(_reports(spark, folder))
    told = F.transform("events", lambda e: F.concat_ws(" ", *[e[f] for f in rows.schema["events"].dataType.elementType.names]))
    return rows.select("video_id", "summary", F.array_join(told, "; ").alias("events"), "risk", F.array_join("actions", ",").alias("actions"))


@Q(
    _CRITICAL
    + f""", m AS (SELECT *, least(60000 + CAST(floor(ms / 2.0::DOUBLE + 0.5) AS BIGINT), 900000000) AS t FROM c)
SELECT video_id, string_agg(t || ' ' || {_CLOCK.format("(t // 1000)")}, '; ' ORDER BY pos) AS moved FROM m GROUP BY video_id"""
)
def f09_rebased_events(spark, folder):
    """The events of clips that play at half speed from the first minute on, in the recordings' time."""
    moved = clock.rebased_events(F.col("events"), F.lit(60_000).cast("long"), F.lit(900_000_000).cast("long"), F.lit(2.0))
    told = F.transform(moved, lambda e: F.concat_ws(" ", e["t_ms"].cast("string"), e["time"]))
    return _reports(spark, folder).select("video_id", F.array_join(told, "; ").alias("moved"))


@Q(
    f"""WITH {S.TRUTH}, m AS (SELECT g.video_id, g.t_ms, min(abs(p.t_ms - g.t_ms)) AS miss FROM gt g LEFT JOIN pred p USING (video_id) GROUP BY ALL),
vm AS (SELECT video_id, count(*) AS total, count(*) FILTER (WHERE miss <= 21600000) AS covered FROM m GROUP BY video_id)
SELECT 'settings' AS part, '{{"budget":16,"tolerance_ms":21600000}}' AS body
UNION ALL SELECT 'video', '{{"video_id":' || video_id || ',"total":' || total || ',"covered":' || covered || '}}' FROM vm
UNION ALL SELECT 'total', '{{"videos":' || count(*) || ',"covered":' || sum(covered) || '}}' FROM vm"""
)
def k11_result_document(spark, folder):
    """A benchmark's result as JSON: settings, each recording, total."""
    rows = metrics.video_metrics(views.truth(spark, folder), views.predictions(spark, folder), 21_600_000).select("video_id", "total", "covered")
    total = rows.agg(F.count("*").alias("videos"), F.sum("covered").alias("covered"))
    return reports.result_document({"budget": 16, "tolerance_ms": 21_600_000}, rows, total)


@Q("SELECT event_id, coalesce(CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_name END, r.r_name, '#' || (user_id % 30)) AS name FROM events LEFT JOIN nation n ON n.n_nationkey = user_id % 30 LEFT JOIN region r ON r.r_regionkey = user_id % 30")
def j21_display_names(spark, folder):
    """The name under which a class is shown: that of the labels, else that of the results, else its number."""
    rows = table(spark, folder, "events").select("event_id", (F.col("user_id") % 30).alias("index"))
    labels = table(spark, folder, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"))
    results = table(spark, folder, "region").select(F.col("r_regionkey").alias("index"), F.col("r_name").alias("name"))
    return joins.display_names(rows, "index", labels, results).select("event_id", "name")


@Q("SELECT conv_id, max(turn) AS last_turn, count(*) AS turns FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT conv_id, max(turn) + 1 FROM conversations GROUP BY conv_id) GROUP BY conv_id")
def q10_append(spark, folder):
    """A message appended to each conversation."""
    c = table(spark, folder, "conversations")
    new = c.groupBy("conv_id").agg((F.max("turn") + 1).cast(c.schema["turn"].dataType).alias("turn"))
    return joins.appended(c, new).groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns"))


@Q(
    """WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0)
SELECT 'orders' AS name, count(*) AS rows_left, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone)"""
)
def k03_cascade(spark, folder):
    """Owners deleted with all that is theirs, table by table."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    left = joins.cascade_deleted({"customer": c.select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id")), "orders": o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))}, c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")), "k")
    told = lambda name: left[name].agg(F.lit(name).alias("name"), F.count("*").alias("rows_left"), F.sum("id").alias("keys"))
    return told("orders").union(told("customer"))
