"""Queries that run streams and commits over the tables: what a stream leaves behind is what one query over all of it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline import schemas
from sightline.operators import profile, rates, sampling, scoring
from sightline.plans import frames as P
from sightline.plans import sql as S
from sightline.plans.book import Book
from sightline.sources import views
from sightline.sources.folders import shared_folder
from sightline.sources.views import table
from sightline.streaming import commits, jobs, loop, requests

Q = Book()
r6 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)


def _arrivals(spark: SparkSession, folder: str, rows: DataFrame, work, batches: list, schema: str, mode: str = "append") -> DataFrame:
    """What a stream leaves behind that ran after each of the batches (conditions on rows) had come, with one checkpoint."""
    base = shared_folder(spark, "arrivals")
    for cond in batches:
        rows.filter(cond).write.mode("append").parquet(f"{base}/in")
        stream = work(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/position").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


_LATE = "event_id % 10 = 0"


@Q(
    f"""WITH e AS (SELECT user_id % 20 AS video_id, ts, value, event_id, CASE WHEN {_LATE} THEN 1 ELSE 0 END AS batch FROM events), m AS (SELECT max(ts) FILTER (WHERE batch = 0) - INTERVAL 2 DAY AS wm0, max(ts) - INTERVAL 2 DAY AS wm1 FROM e),
w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM e), k AS (SELECT w.*, wm1 FROM w, m WHERE batch = 0 OR start + INTERVAL 6 HOUR > wm0)
SELECT video_id, epoch_us(start) // 1000 AS start_ms, count(*) AS n, round(max(value), 6) AS top FROM k WHERE start + INTERVAL 6 HOUR <= wm1 GROUP BY ALL"""
)
def x05_late_data(spark, folder):
    """Tumbling windows of a stream that gets a tenth of its events late: those that come after their window has passed by the
    watermark are dropped, and windows are told of once they have."""
    rows = table(spark, folder, "events").select((F.col("user_id") % 20).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    out = _arrivals(spark, folder, rows, lambda s: jobs.tumbling(s, "6 hours", "2 days"), [f"not ({_LATE})", _LATE], "video_id bigint, start timestamp, n bigint, top double")
    return out.select("video_id", F.unix_millis("start").alias("start_ms"), "n", r6("top"))


@Q("""WITH e AS (SELECT user_id AS video_id, event_id AS request, event_type = 'error' AS reset FROM events), g AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY request) AS run FROM e)
SELECT video_id, request, reset OR sum(CASE WHEN reset THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, run ORDER BY request) <= 2 AS allowed FROM g""")
def x06_limited(spark, folder):
    """Two requests between resets, counted in a stream's state."""
    rows = table(spark, folder, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("request"), (F.col("event_type") == "error").alias("reset"))
    half = table(spark, folder, "events").agg(F.max("event_id")).first()[0] // 2
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _arrivals(spark, folder, rows, jobs.limited, [f"request <= {half}", f"request > {half}"], "video_id bigint, request bigint, allowed boolean")


@Q("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::BIGINT AS version, o_orderstatus <> 'F' AS followed FROM orders")
def x08_feed(spark, folder):
    """A subscriber that reads a table as of its first version and then follows the stream of its commits: all rows once."""
    log = commits.Commits(spark, shared_folder(spark, "feed"))
    rows, schema = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey bigint, o_orderstatus string"
    log.commit({"orders": rows.filter("o_orderstatus = 'F'")})
    at = log.version()
    out = f"{log.path}/followed"
    for status in ("O", "P"):
        log.commit({"orders": rows.filter(F.col("o_orderstatus") == status)})
        follow = commits.follow(log, "orders", schema, at, lambda df: df.write.mode("append").parquet(out))
        log.new_commits().writeStream.foreachBatch(follow).option("checkpointLocation", f"{log.path}/position").trigger(availableNow=True).start().awaitTermination()
    first = log.read("orders", schema, until=at)
    later = spark.read.schema(f"{schema}, _version bigint").parquet(out)
    return first.withColumn("followed", F.lit(False)).unionByName(later.withColumn("followed", F.lit(True))).select("o_orderkey", F.col("_version").alias("version"), "followed")


def _hear(row: dict) -> dict:
    if int(row["video_id"]) % 5 == 0:
        raise RuntimeError("no sound track")
    return {"context": f"heard {row['video_id']}"}


def _see(row: dict) -> dict:
    if int(row["video_id"]) % 7 == 0:
        raise ValueError("too dark")
    return {"summary": row["context"], "events": "[]", "risk": "low", "actions": ["look"]}


@Q(
    """WITH m AS (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS ms FROM customer)
SELECT k::VARCHAR AS video_id, CASE WHEN ms < 200 THEN 'too_short' WHEN k % 7 = 0 THEN 'no report: ValueError: too dark' ELSE 'report' END AS state, CASE WHEN ms >= 200 AND k % 7 <> 0 AND k % 5 <> 0 THEN 'heard ' || k WHEN ms >= 200 AND k % 7 <> 0 THEN '' END AS summary FROM m"""
)
def x09_recording_loop(spark, folder):
    """The loop over new recordings, some too short, some without sound, some whose vision fails; the batch comes twice."""
    log = commits.Commits(spark, shared_folder(spark, "loop"))
    key, ms = F.col("c_custkey").cast("string"), F.floor("c_acctbal")
    rows = table(spark, folder, "customer").select(F.lit(1).alias("schema_version"), key.alias("video_id"), F.concat(F.lit("raw/"), key).alias("object_key"), ms.alias("duration_ms"), F.lit(25.0).alias("fps"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.lit(1).cast("long").alias("size_bytes"), F.lit("h264").alias("codec"), F.lit(None).cast("timestamp").alias("ingested_at"))
    step = loop.recording_loop(log, "loop", loop.guarded(_hear, "context string"), loop.guarded(_see, "summary string, events string, risk string, actions array<string>"))
    step(rows, 0)
    step(rows, 0)
    done = log.read("reports", loop.REPORTS).select("video_id", F.lit("report").alias("state"), "summary")
    refused = log.read("refused", loop.REFUSED).select("video_id", F.col("reason").alias("state"), F.lit(None).cast("string").alias("summary"))
    failed = log.read("messages", loop.MESSAGES).filter("channel = 'trace' and seq = 2").select("video_id", F.col("body").alias("state"), F.lit(None).cast("string").alias("summary"))
    return done.unionByName(refused).unionByName(failed)


@Q("SELECT o_custkey AS k, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def x12_upserts(spark, folder):
    """The latest row of each key in a table that a stream's batches keep: an empty one first, one that comes twice, and old rows."""
    path = shared_folder(spark, "latest")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    sink = jobs.upsert_sink(path, ["k"], ["version"])
    for epoch, batch in enumerate((rows.limit(0), rows.filter("version % 2 = 0"), rows.filter("version % 2 = 0"), rows)):
        sink(batch, epoch)
    return jobs.latest_rows(spark, path).select("k", "version", "status")


@Q(
    P._CHOSEN
    + """, x AS (SELECT video_id, idx FROM chosen UNION SELECT video_id, idx FROM prof WHERE idx % 50 = 7)
SELECT x.video_id::VARCHAR AS video_id, p.t_ms, 'frames/' || x.video_id || '/' || lpad(x.idx::VARCHAR, 9, '0') || '.jpg' AS object_key, round(CASE WHEN c.idx IS NULL THEN 0 ELSE p.score::DOUBLE END, 6) AS motion_score, coalesce(c.reason = 'scene_cut', false) AS is_scene_cut, (count(*) OVER (PARTITION BY x.video_id))::INTEGER AS in_message
FROM x JOIN prof p ON p.video_id = x.video_id AND p.idx = x.idx LEFT JOIN chosen c ON c.video_id = x.video_id AND c.idx = x.idx"""
)
def k08_frames_delivered(spark, folder):
    """The extracted frames of each recording, with what is known of those that were asked for, and how many its message lists.
    A frame is known by its recording and time, of which the tables have no two alike."""
    rows = views.profile(spark, folder)
    chosen = sampling.marked_frames(rows, 16, 0.25).filter("reason is not null or idx % 50 = 7").withColumn("key", F.concat(F.lit("frames/"), F.col("video_id").cast("string"), F.lit("/"), F.lpad(F.col("idx").cast("string"), 9, "0"), F.lit(".jpg")))
    asked = chosen.filter("reason is not null").select(F.col("video_id").cast("string").alias("video_id"), "t_ms", "score", (F.col("reason") == "scene_cut").alias("is_scene_cut"))
    extracted = chosen.select(F.col("video_id").cast("string").alias("video_id"), "t_ms", F.col("key").alias("object_key"))
    log = commits.Commits(spark, shared_folder(spark, "frames"))
    loop.frames_delivered(log, asked, extracted, "overview", "b")
    listed = log.read("messages", loop.MESSAGES).select("video_id", F.size(F.from_json(F.get_json_object("body", "$.frames"), "array<struct<t_ms:bigint>>")).alias("in_message"))
    return log.read("frame_refs", loop.FRAME_REFS).join(listed, "video_id").select("video_id", "t_ms", "object_key", r6("motion_score"), "is_scene_cut", "in_message")


def _twice(x: dict) -> dict:
    if x["k"] % 5 == 0:
        raise ValueError("a fifth is refused")
    return {"twice": 2 * x["k"]}


def _broken(x: dict) -> dict:
    return {"never": 1 // 0}


@Q(
    """WITH r AS (SELECT event_id, event_type AS tool, CASE WHEN event_id % 9 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events)
SELECT 'r' || event_id AS reply, tool, CASE WHEN tool = 'error' THEN 'unknown_tool' WHEN k IS NULL THEN 'bad_request' WHEN tool = 'view' THEN 'internal' WHEN tool IN ('signup', 'purchase') THEN 'unknown_tool' WHEN k % 5 = 0 THEN 'bad_request' ELSE 'ok' END AS code, CASE WHEN tool = 'click' AND k % 5 <> 0 THEN 2 * k END AS twice FROM r"""
)
def m03_replies(spark, folder):
    """Requests to tools: one is served, one always fails, two are in the catalog alone, one is nowhere, some payloads are broken."""
    rows = table(spark, folder, "events").select(F.concat(F.lit("stream.tool."), "event_type").alias("subject"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reply"), F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props")).alias("payload"))
    catalog = spark.createDataFrame([(n,) for n in ("click", "view", "signup", "purchase")], "name string")
    out = requests.answered(requests.routed(rows, catalog), {"click": _twice, "view": _broken})
    return out.select("reply", "tool", "code", F.get_json_object("body", "$.twice").cast("long").alias("twice"))


@Q("SELECT o_custkey::VARCHAR AS video_id, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms FROM orders WHERE o_orderkey % 3 = 0")
def m02_decoded(spark, folder):
    """Messages of which a third can be read; others are cut off or tell of no recording."""
    good = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("o_custkey").cast("string").alias("video_id"), F.floor("o_totalprice").alias("duration_ms")))
    value = F.when(F.col("o_orderkey") % 3 == 0, good).when(F.col("o_orderkey") % 3 == 1, F.substring(good, 1, 20)).otherwise('{"schema_version": 1}')
    return jobs.decoded(table(spark, folder, "orders").select(value.alias("value")), schemas.INGESTED).select("video_id", "duration_ms")


@Q(f"WITH {S.PROFILE} SELECT video_id, idx, t_ms, round(score::DOUBLE, 6) AS score FROM prof")
def s21_stored_profiles(spark, folder):
    """Profiles from a read-through store that has every third recording already and works out the rest."""
    log, frames = commits.Commits(spark, shared_folder(spark, "profiles")), views.frames(spark, folder)
    wanted = frames.groupBy("video_id").agg(F.concat_ws("/", F.count("*"), F.max("t_ms")).alias("mark"))

    def work(missing: DataFrame) -> DataFrame:
        return profile.normalised(frames.join(missing.select("video_id"), "video_id", "left_semi")).select("video_id", "idx", "t_ms", "score")

    schema = "video_id bigint, idx bigint, t_ms bigint, score float"
    commits.worked_out_once(log, "profiles", schema, wanted.filter("video_id % 3 = 0"), work)
    return commits.worked_out_once(log, "profiles", schema, wanted, work).select("video_id", "idx", "t_ms", r6("score"))


_COUNTERS = "s AS (SELECT event_type AS job, user_id % 3 AS instance, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_id, (row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) % 40)::DOUBLE AS value FROM events)"
_RATES = f"""{_COUNTERS}, g AS (SELECT *, lag(t) OVER w AS before_t, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS gain FROM s WINDOW w AS (PARTITION BY job, instance ORDER BY t, event_id)),
l AS (SELECT *, unnest(range(CAST(ceil(t / 43200) AS BIGINT), CAST(ceil((t + 86400) / 43200) AS BIGINT))) * 43200.0::DOUBLE AS at_s FROM g),
a AS (SELECT job, instance, at_s, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(value, t) AS v0, coalesce(sum(gain) FILTER (WHERE before_t > at_s - 86400), 0) AS gain FROM l GROUP BY ALL HAVING count(*) > 1 AND max(t) > min(t)),
b AS (SELECT *, t1 - t0 AS span, (t1 - t0) / (n - 1) AS mean, CASE WHEN gain > 0 AND v0 >= 0 THEN least(t0 - (at_s - 86400), (t1 - t0) * v0 / gain) ELSE t0 - (at_s - 86400) END AS lead, at_s - t1 AS tail FROM a),
r AS (SELECT job, instance, at_s, gain * (span + CASE WHEN lead < 1.1::DOUBLE * mean THEN lead ELSE mean / 2 END + CASE WHEN tail < 1.1::DOUBLE * mean THEN tail ELSE mean / 2 END) / span / 86400 AS rate FROM b)"""


def _counters(spark, folder):
    line = Window.partitionBy("event_type", F.col("user_id") % 3).orderBy("ts", "event_id")
    return table(spark, folder, "events").select(F.col("event_type").alias("job"), (F.col("user_id") % 3).alias("instance"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), (F.row_number().over(line) % 40).cast("double").alias("value"))


@Q(f"WITH {_RATES} SELECT job, instance, at_s, round(rate, 9) AS rate FROM r")
def a28_rates(spark, folder):
    """Counters that begin anew after forty events: increases a second over a day, twice a day."""
    return rates.rates(_counters(spark, folder), ["job", "instance"], 86_400, 43_200).withColumn("rate", F.round("rate", 9)).withColumnRenamed("at", "at_s")


@Q(f"WITH {_RATES} SELECT at_s, round(sum(rate), 9) AS rate, round(coalesce(sum(rate) FILTER (WHERE job = 'error'), 0) / nullif(sum(rate), 0) * 100, 6) AS percent FROM r GROUP BY at_s")
def a28_error_share(spark, folder):
    found = rates.rates(_counters(spark, folder), ["job", "instance"], 86_400, 43_200)
    return rates.error_share(found, [], F.col("job") == "error").select(F.col("at").alias("at_s"), F.round("rate", 9).alias("rate"), r6("percent"))


@Q(f"""WITH {_COUNTERS}, l AS (SELECT *, unnest(range(CAST(ceil(t / 43200) AS BIGINT), CAST(ceil((t + 86400) / 43200) AS BIGINT))) * 43200.0::DOUBLE AS at_s FROM s), n AS (SELECT job, instance, at_s, arg_max(value, t) AS value FROM l GROUP BY ALL) SELECT job, at_s, sum(value) AS value FROM n GROUP BY ALL""")
def a28_gauge_sums(spark, folder):
    return rates.gauge_sums(_counters(spark, folder), ["job", "instance"], ["job"], 43_200, 86_400).withColumnRenamed("at", "at_s")


@Q("""WITH b AS (SELECT user_id AS job, unnest([1.0, 5.0, 20.0, 60.0, 'inf'::DOUBLE]) AS le, value FROM events), c AS (SELECT job, le, count(*) FILTER (WHERE value <= le)::DOUBLE AS n FROM b GROUP BY ALL),
w AS (SELECT *, lag(le) OVER v AS low, coalesce(lag(n) OVER v, 0) AS below, 0.95::DOUBLE * max(n) OVER (PARTITION BY job) AS rank FROM c WINDOW v AS (PARTITION BY job ORDER BY le))
SELECT job, round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (rank - below) / nullif(n - below, 0) END, le) FILTER (WHERE n >= rank), 6) AS value FROM w GROUP BY job""")
def a28_histogram(spark, folder):
    """A quantile from cumulative buckets with bounds, the last one infinite."""
    bounds = F.array(*[F.lit(float(x)) for x in ("1", "5", "20", "60", "inf")])
    rows = table(spark, folder, "events").select(F.col("user_id").alias("job"), "value", F.explode(bounds).alias("le"))
    buckets = rows.groupBy("job", "le").agg(F.sum(F.when(F.col("value") <= F.col("le"), 1.0).otherwise(0.0)).alias("count"))
    return rates.histogram_quantile(buckets, ["job"], 0.95).select("job", r6("value"))


def _stub():
    def model(x):
        if len(x) > 5:
            raise RuntimeError("device hung")
        return x.astype("float64").max(axis=(1, 2))[:, None] * [1.0, 2.0]

    return model


@Q("SELECT label::BIGINT AS video_id, vec_id AS w, c AS class_index, round(list_max(embedding)::DOUBLE * (c + 1), 5) AS score FROM embeddings, (VALUES (0), (1)) v(c)")
def x11_window_scores(spark, folder):
    """Windows scored in batches by a model whose memory holds five of them."""
    rows = table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("w"), F.lit(4).alias("bands"), F.col("embedding").alias("features"))
    return scoring.window_scores(rows, _stub, 32, -1.0).select("video_id", "w", "class_index", F.round(F.col("score").cast("double"), 5).alias("score"))
