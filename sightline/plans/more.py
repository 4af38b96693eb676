"""Queries on the smaller predicates, lookups, top-k rules, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import checks, media, text
from sightline.operators import joins, prompts, reports, segments
from sightline.plans import sql as S
from sightline.plans.book import Book
from sightline.sources import views
from sightline.sources.views import table

Q = Book()
r6 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)


@Q("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'bad_range' WHEN event_id % 4 = 1 THEN 'no_budget' WHEN event_id % 4 = 2 AND value > 50 THEN 'beyond_end' END AS error, least(event_id + 100, 5000) AS t1 FROM events")
def p05_range_errors(spark, folder):
    k = F.col("event_id") % 4
    t0, t1 = F.col("event_id"), F.when(k == 0, F.col("event_id")).otherwise(F.col("event_id") + 100)
    budget, at, duration = F.when(k == 1, 0).otherwise(16), F.when(k == 2, F.col("value")).otherwise(0.0), 50.0
    error = checks.range_error(t0, t1, budget, at, F.lit(duration))
    kept = checks.clamped_range(t0, F.col("event_id") + 100, F.lit(5000))
    return table(spark, folder, "events").select("event_id", error.alias("error"), kept["t1"].alias("t1"))


@Q("SELECT event_id, least(greatest(value / 100, 0.01), 0.99) AS threshold, least(greatest(event_id, 1), 20) AS top_k, least(greatest(event_id * 3, 1), 5000) AS max_events FROM events")
def p07_clamped(spark, folder):
    within = checks.within
    return table(spark, folder, "events").select("event_id", within(F.col("value") / 100, 0.01, 0.99).alias("threshold"), within(F.col("event_id"), 1, 20).alias("top_k"), within(F.col("event_id") * 3, 1, 5000).alias("max_events"))


@Q("SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE coalesce(text, '') END) <> '' AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS valid FROM documents")
def p11_valid_reports(spark, folder):
    """Reports with a summary and an action; some have a blank summary, no actions or none told."""
    summary = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text"))
    actions = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    return table(spark, folder, "documents").select("doc_id", checks.valid_report(summary, actions).alias("valid"))


@Q("SELECT doc_id, contains(text, 'the') AND contains(text, 'er') AND contains(text, 'on') AND contains(text, 'an') AS holds FROM documents")
def p14_contract(spark, folder):
    return table(spark, folder, "documents").select("doc_id", checks.holds_all(F.col("text"), ["the", "er", "on", "an"]).alias("holds"))


@Q("SELECT event_id FROM events WHERE regexp_matches(event_type, '(?i)(error|warn)')")
def p15_pattern_filter(spark, folder):
    return table(spark, folder, "events").filter(F.col("event_type").rlike("(?i)(error|warn)")).select("event_id")


@Q("SELECT d.doc_id, coalesce(toxic, 0) AS confidence FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL AND d.n_chars IS NOT NULL")
def p16_required_fields(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.filter("lang is not null and n_chars is not null").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("confidence"))


@Q("SELECT doc_id, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), '') AS context FROM documents")
def p20_blank_as_absent(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.non_blank(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang"))).alias("context"))


@Q(f"WITH {S.DIMENSION} SELECT e.event_id, d.category, d.severity FROM events e LEFT JOIN dim d ON e.event_type = d.label AND d.severity <> 'info'")
def j03_nullable_dimension(spark, folder):
    dim = views.dimension(spark).filter("severity <> 'info'")
    return table(spark, folder, "events").join(F.broadcast(dim), F.col("event_type") == F.col("label"), "left").select("event_id", "category", "severity")


@Q(f"WITH {S.TRUTH} SELECT g.video_id, g.t_ms, arg_min(p.t_ms, [abs(p.t_ms - g.t_ms), p.t_ms]) AS frame_ms FROM gt g LEFT JOIN pred p USING (video_id) GROUP BY ALL")
def j10_nearest_frame(spark, folder):
    return joins.nearest(views.truth(spark, folder), views.predictions(spark, folder)).select("video_id", "t_ms", F.col("n_t").alias("frame_ms"))


@Q(f"WITH {S.PROFILE} SELECT f.video_id, f.t_ms, round(coalesce(p.score, 0)::DOUBLE, 6) AS score, coalesce(p.is_scene_cut, false) AS cut FROM frames f LEFT JOIN (SELECT * FROM prof WHERE idx % 3 = 0) p ON p.video_id = f.video_id AND p.idx = f.idx")
def j15_frame_defaults(spark, folder):
    chosen = views.profile(spark, folder).filter("idx % 3 = 0").select("video_id", "idx", "score", "is_scene_cut")
    rows = views.frames(spark, folder).join(chosen, ["video_id", "idx"], "left")
    return rows.select("video_id", "t_ms", F.round(F.coalesce("score", F.lit(0.0)).cast("double"), 6).alias("score"), F.coalesce("is_scene_cut", F.lit(False)).alias("cut"))


@Q("SELECT o.o_orderkey, coalesce(c.c_name, 'agent ' || o.o_custkey) AS title FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o.o_custkey = c.c_custkey")
def j22_registry_defaults(spark, folder):
    known = table(spark, folder, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name")
    rows = table(spark, folder, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("agent "), F.col("o_custkey").cast("string"))).alias("title"))


@Q(f"WITH {S.FRAMES}, iv AS (SELECT video_id, t_ms AS a, t_ms + 3600000 AS b FROM frames WHERE event_type = 'error') SELECT video_id, idx FROM frames f WHERE EXISTS (SELECT 1 FROM iv WHERE iv.video_id = f.video_id AND f.t_ms BETWEEN a AND b)")
def j20_interval_membership(spark, folder):
    rows = views.frames(spark, folder)
    spans = rows.filter("event_type = 'error'").select("video_id", F.col("t_ms").alias("a"), (F.col("t_ms") + 3_600_000).alias("b"))
    return joins.points_in_ranges(rows, spans, 3_600_000, "left_semi").select("video_id", "idx")


@Q(f"WITH {S.FRAMES} SELECT video_id, count(*) AS windows, sum(raw) AS total FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY raw DESC, event_id) AS nth FROM frames) WHERE nth <= 4 GROUP BY video_id".replace("sum(raw) AS total", "round(sum(raw), 6) AS total"))
def t07_top_totals(spark, folder):
    rank = Window.partitionBy("video_id").orderBy(F.col("raw").desc(), "event_id")
    rows = views.frames(spark, folder).withColumn("nth", F.row_number().over(rank)).filter("nth <= 4")
    return rows.groupBy("video_id").agg(F.count("*").alias("windows"), F.round(F.sum("raw"), 6).alias("total"))


@Q(f"WITH {S.EVENTS}, l AS (SELECT video_id, list(label ORDER BY \"start\" DESC, pos DESC) AS a FROM ev WHERE category = 'machine' GROUP BY video_id) SELECT video_id, 'alarm,' || array_to_string(a[1:4], ',') AS evidence FROM l")
def t07_last_activities(spark, folder):
    """The last four activities, newest first, behind the alarm."""
    newest = Window.partitionBy("video_id").orderBy(F.col("start").desc(), F.col("pos").desc())
    rows = views.interval_events(spark, folder).filter("category = 'machine'").withColumn("nth", F.row_number().over(newest)).filter("nth <= 4")
    rows = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("nth", "label"))).alias("a"))
    last = F.transform("a", lambda x: x["label"])
    return rows.select("video_id", F.array_join(F.concat(F.array(F.lit("alarm")), last), ",").alias("evidence"))


@Q(f"WITH {S.SCORES} SELECT video_id, w, event_type AS cls FROM scores WHERE score >= 0.35::DOUBLE QUALIFY row_number() OVER (PARTITION BY video_id, w ORDER BY (event_type = 'error') DESC, score DESC, event_type) = 1")
def t08_alert_override(spark, folder):
    """The dominant class of a window, an alert before all others."""
    return segments.picked_class(views.class_scores(spark, folder).withColumnRenamed("event_type", "class"), 0.35, ["error"])


@Q("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 3")
def t09_recent(spark, folder):
    return table(spark, folder, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(3).select("o_orderkey", "o_custkey")


@Q("SELECT count(*) AS added FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def q05_unique_insert(spark, folder):
    """Rows that a uniqueness check lets in."""
    new = table(spark, folder, "customer")
    return new.join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("added"))


@Q("SELECT o_custkey AS agent, o_orderpriority AS fragment, max(o_orderkey) AS version FROM orders GROUP BY ALL")
def q13_composite_upsert(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("agent"), F.col("o_orderpriority").alias("fragment"), F.col("o_orderkey").alias("version"))
    return joins.upserted(rows.limit(0), rows, ["agent", "fragment"], ["version"])


@Q("SELECT o_custkey || '/' || o_orderpriority AS id, count(*) AS n FROM orders GROUP BY ALL")
def q12_override_ids(spark, folder):
    return table(spark, folder, "orders").groupBy(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("id")).agg(F.count("*").alias("n"))


@Q(f"WITH {S.FRAMES} SELECT video_id, idx, dense_rank() OVER (PARTITION BY video_id ORDER BY t_ms // 86400000) - 1 AS chunk, idx + (dense_rank() OVER (PARTITION BY video_id ORDER BY t_ms // 86400000) - 1) * 4 AS step FROM frames")
def w16_step_numbers(spark, folder):
    chunk = F.dense_rank().over(Window.partitionBy("video_id").orderBy(F.expr("t_ms div 86400000"))) - 1
    return views.frames(spark, folder).withColumn("chunk", chunk.cast("long")).select("video_id", "idx", "chunk", (F.col("idx") + F.col("chunk") * 4).alias("step"))


@Q(f"WITH {S.FRAMES} SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY t_ms, event_id) AS ordinal FROM frames WHERE event_type = 'click'")
def w15_ordinals(spark, folder):
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t_ms", "event_id"))
    return views.frames(spark, folder).filter("event_type = 'click'").select("video_id", "idx", n.cast("long").alias("ordinal"))


@Q("SELECT event_id, least(greatest(value / 50, 0), 1) AS x, CASE WHEN 1 - greatest(value / 50, 0) < 0.01 THEN 0.01 ELSE least(greatest(0.5::DOUBLE, 0.01), 1 - greatest(value / 50, 0)) END AS w FROM events")
def f14_crop(spark, folder):
    """A crop's corner and width within the frame; at the far edge the least width is kept."""
    fitted = checks.crop(F.col("value") / 50, F.lit(0.0), F.lit(0.5), F.lit(0.5))
    return table(spark, folder, "events").select("event_id", fitted["x"].alias("x"), fitted["w"].alias("w"))


@Q("SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(700 * (pow(10, value / 2595) - 1), 6) AS hz FROM events")
def f18_mel(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select("event_id", F.round(media.mel_of(v), 6).alias("mel"), F.round(media.hz_of(v), 6).alias("hz"))


@Q("SELECT event_id, props AS body, json_extract(props, '$.k')::BIGINT AS k FROM events")
def f19_json_body(spark, folder):
    said = text.json_body(F.concat(F.lit("sure: "), F.col("props"), F.lit(" ok")))
    return table(spark, folder, "events").select("event_id", said.alias("body"), F.get_json_object(said, "$.k").cast("long").alias("k"))


@Q("SELECT event_id, event_type AS said, CASE WHEN event_id % 5 < 2 THEN props END AS call, CASE WHEN event_id % 5 < 2 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events")
def f21_tool_call(spark, folder):
    """Text before the marker of a tool call, and the call behind it: with words after it, without any, broken, missing, unmarked."""
    k, marked = F.col("event_id") % 5, F.concat(F.lit("\t "), F.col("event_type"), F.lit("\n[TOOL_CALL]"))
    whole = F.when(k == 0, F.concat(marked, F.lit("\n"), "props", F.lit(" as [TOOL_CALL] asked"))).when(k == 1, F.concat(marked, "props")).when(k == 2, F.concat(marked, F.lit('{"k": }'))).when(k == 3, marked).otherwise(F.col("event_type"))
    parts = text.tool_call(whole)
    return table(spark, folder, "events").select("event_id", parts["said"].alias("said"), parts["call"].alias("call"), F.get_json_object(parts["call"], "$.k").cast("long").alias("k"))


@Q("SELECT c_nationkey, string_agg(c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey) AS prompt FROM customer GROUP BY c_nationkey")
def f25_fragments(spark, folder):
    """Fragments joined by a blank line, those that begin with white space without one."""
    rows = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.col("c_mktsegment").alias("t")))).alias("l"))
    return rows.select("c_nationkey", prompts.glued(F.transform("l", lambda x: x["t"])).alias("prompt"))


@Q("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 100) / (event_id % 5)::DOUBLE END AS rate FROM events")
def f28_rational(spark, folder):
    said = F.concat_ws("/", (F.col("event_id") % 100).cast("string"), (F.col("event_id") % 5).cast("string"))
    return table(spark, folder, "events").select("event_id", checks.rational(said).alias("rate"))


@Q(
    f"""WITH {S.PROFILE}, l AS (SELECT video_id, idx // 10 AS w, idx % 10 AS place, score::DOUBLE * 200 - 160 AS level FROM prof), t AS (SELECT video_id, w, max(level) - 120 AS fl FROM l GROUP BY ALL)
SELECT t.video_id, t.w::BIGINT AS w, p::BIGINT AS place, round(greatest(coalesce(level, fl), fl), 6) AS level FROM t CROSS JOIN range(10) r(p) LEFT JOIN l ON l.video_id = t.video_id AND l.w = t.w AND l.place = p"""
)
def f30_window_floor(spark, folder):
    """Decibels no lower than 120 below the best of their window of ten; the last window is filled with its floor."""
    rows = views.profile(spark, folder).select("video_id", "idx", (F.col("score").cast("double") * 200 - 160).alias("level"))
    return media.window_floor(rows, 10).select("video_id", "w", "place", r6("level"))


@Q("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def f34_token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.expr("cast(length(text) div 4 as bigint)").alias("tokens"))


@Q("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'parse_error' ELSE event_type END AS category FROM events")
def f35_code_fence(spark, folder):
    """The category of an answer that may be fenced as code; parse_error if it is no JSON."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('```json\n{"category": "'), "event_type", F.lit('"}\n```'))).when(F.col("event_id") % 3 == 1, "I think it is fine").otherwise(F.concat(F.lit('{"category": "'), "event_type", F.lit('"}')))
    bare = text.without_code_fence(said)
    return table(spark, folder, "events").select("event_id", F.coalesce(F.get_json_object(bare, "$.category"), F.lit("parse_error")).alias("category"))


@Q("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'watch' ELSE lang END AS actions, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'no summary') AS summary FROM documents")
def f36_report_defaults(spark, folder):
    actions = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("lang"))
    told = reports.with_defaults(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), actions, "no summary", "watch")
    return table(spark, folder, "documents").select("doc_id", F.array_join(told["actions"], ",").alias("actions"), told["summary"].alias("summary"))


@Q("SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'localhost' WHEN 1 THEN '[::1]' WHEN 2 THEN '127.0.0.1' END AS host FROM pages")
def f37_origin_hosts(spark, folder):
    """Origins that a request may come from, among those that only look like one and the pages' own."""
    k = F.col("page_id") % 8
    origin = F.when(k == 0, "http://localhost:3000").when(k == 1, "http://[::1]:8080").when(k == 2, "https://127.0.0.1").when(k == 3, "https://evil-localhost:3000").when(k == 4, "http://localhost.example.net")
    origin = origin.when(k == 5, "localhost:3000").when(k == 6, "http://[::1]x:80@example.net").otherwise(F.col("url"))
    origin = F.when(k == 6, "http://127.0.0.1.example.net:80").otherwise(origin)
    return table(spark, folder, "pages").select("page_id", checks.origin_host(origin).alias("host"))


@Q("SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS body FROM events")
def f38_alert_json(spark, folder):
    return table(spark, folder, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("body"))


@Q("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def k15_export(spark, folder):
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("l", lambda x: x["role"]), ">").alias("roles"))


@Q("SELECT 'a' AS agent, doc_id AS id FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', doc_id FROM labels WHERE quality = 0")
def u02_two_agents(spark, folder):
    a = table(spark, folder, "documents").filter("lang = 'en'").select(F.lit("a").alias("agent"), F.col("doc_id").alias("id"))
    b = table(spark, folder, "labels").filter("quality = 0").select(F.lit("b").alias("agent"), F.col("doc_id").alias("id"))
    return a.unionByName(b)


@Q(f"WITH {S.FRAMES}, s AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY t_ms, event_id) >= 43200000 OR lag(t_ms) OVER (PARTITION BY video_id ORDER BY t_ms, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM frames), n AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY t_ms, event_id) AS session FROM s) SELECT video_id, min(t_ms) AS t0, max(t_ms) + 43200000 AS t1, count(*) AS n FROM n GROUP BY video_id, session")
def x03_sessions(spark, folder):
    """Sessions of events less than twelve hours apart by Spark's session windows, which end a gap after the last event."""
    rows = views.frames(spark, folder).withColumn("ts", F.timestamp_millis("t_ms"))
    out = rows.groupBy("video_id", F.session_window("ts", "12 hours").alias("s")).agg(F.count("*").alias("n"))
    return out.select("video_id", F.unix_millis("s.start").alias("t0"), F.unix_millis("s.end").alias("t1"), "n")


@Q("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j16_fragment_owners(spark, folder):
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")
