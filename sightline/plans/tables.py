"""Queries on the relational surface: registries, upserts, histories, permissions, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import checks, text
from sightline.operators import joins
from sightline.plans.book import Book
from sightline.sources.folders import shared_folder
from sightline.sources.views import table

Q = Book()
_PRIO = "CAST(left(o_orderpriority, 1) AS INT)"


def _registry(spark, folder):
    """(name, version, title): one tool a customer, from its latest order."""
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_custkey").alias("name")).agg(F.max("o_orderkey").alias("version"), F.max_by("o_orderstatus", "o_orderkey").alias("title"))


_REG = "reg AS (SELECT o_custkey AS name, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS title FROM orders GROUP BY o_custkey)"
_NEW = "new AS (SELECT c_custkey AS name, c_custkey + 1000000 AS version, c_mktsegment AS title FROM customer WHERE c_custkey % 3 = 0)"


def _changes(spark, folder):
    return table(spark, folder, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("name"), (F.col("c_custkey") + 1_000_000).alias("version"), F.col("c_mktsegment").alias("title"))


@Q(f"WITH {_REG} SELECT name, version, title FROM reg WHERE name = 7")
def q01_point_lookup(spark, folder):
    return _registry(spark, folder).filter("name = 7")


@Q(f"WITH {_REG}, {_NEW} SELECT coalesce(n.name, r.name) AS name, coalesce(n.version, r.version) AS version, coalesce(n.title, r.title) AS title FROM reg r FULL JOIN new n ON r.name = n.name")
def q02_upsert_latest(spark, folder):
    return joins.upserted(_registry(spark, folder), _changes(spark, folder), ["name"], ["version"])


@Q(f"WITH {_REG} SELECT row_number() OVER (ORDER BY name) AS id, name, title FROM reg")
def q04_ordered_scan(spark, folder):
    """The whole ordered scan. Names are dealt to ranges; a row's number is that in its range plus the rows of those before."""
    # written once: bounds, counts and numbers are read from it
    kept = shared_folder(spark, "registry")
    _registry(spark, folder).select("name", "title").write.parquet(kept)
    rows = spark.read.schema("name bigint, title string").parquet(kept)
    bounds = rows.agg(F.percentile_approx("name", [k / 256 for k in range(1, 256)]).alias("b")).first()["b"] or []
    above = F.lit(0)
    for b in sorted(set(bounds)):
        above = above + (F.col("name") > b).cast("int")
    rows = rows.withColumn("part", F.coalesce(above, F.lit(len(bounds) + 1)))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("name")))
    return numbered.join(F.broadcast(before), F.col("part") == F.col("p")).select((F.col("before") + F.col("nth")).cast("long").alias("id"), "name", "title")


@Q(f"WITH {_REG}, {_NEW} SELECT r.name, r.version, coalesce(n.title, r.title) AS title FROM reg r LEFT JOIN new n ON r.name = n.name")
def q06_update(spark, folder):
    changes = _changes(spark, folder).select("name", F.col("title").alias("new_title"))
    return _registry(spark, folder).join(changes, "name", "left").select("name", "version", F.coalesce("new_title", "title").alias("title"))


@Q(f"WITH {_REG}, {_NEW} SELECT * FROM reg r WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.name = r.name)")
def q07_delete(spark, folder):
    return _registry(spark, folder).join(_changes(spark, folder), "name", "left_anti")


@Q(f"WITH {_REG}, {_NEW} SELECT * FROM reg UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE r.name = n.name)")
def q09_insert_ignore(spark, folder):
    return joins.inserted_if_new(_registry(spark, folder), _changes(spark, folder), ["name"], ["version"])


@Q("SELECT conv_id, turn, role, md5(text) AS content FROM conversations WHERE conv_id = 3")
def q11_history(spark, folder):
    return table(spark, folder, "conversations").filter("conv_id = 3").orderBy("turn").select("conv_id", "turn", "role", F.md5("text").alias("content"))


@Q("SELECT count(*) AS messages FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations g WHERE g.conv_id = c.conv_id AND g.turn = 0 AND g.role = 'system')")
def q17_cascade(spark, folder):
    """Messages left when sessions that open with a system turn are deleted with all of theirs."""
    c = table(spark, folder, "conversations")
    gone = c.filter("turn = 0 and role = 'system'").select("conv_id")
    return c.join(gone, "conv_id", "left_anti").agg(F.count("*").alias("messages"))


@Q("SELECT n_name AS label, coalesce(c, 0)::BIGINT AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def j02_translated(spark, folder):
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return table(spark, folder, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("label"), F.coalesce("c", F.lit(0)).alias("customers"))


@Q(
    """WITH own AS (SELECT o_orderkey AS video, o_custkey AS viewer FROM orders WHERE o_orderstatus = 'F'),
ws AS (SELECT o_orderkey AS video, c2.c_custkey AS viewer FROM orders JOIN customer c1 ON o_custkey = c1.c_custkey JOIN customer c2 ON c2.c_nationkey = c1.c_nationkey)
SELECT viewer, count(*) AS videos FROM (SELECT * FROM own UNION SELECT * FROM ws) GROUP BY viewer"""
)
def j13_permissions(spark, folder):
    """Viewers of a video: its owner if it is open, and all members of the owner's workspace (nation).

    A workspace's videos are counted once and the number is given to its members (customers have one workspace at most);
    the open videos of an owner with a workspace are among them.
    """
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer").filter("c_nationkey is not null")
    homes = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count_distinct("o_orderkey").alias("videos"))
    shared = c.join(F.broadcast(homes), "c_nationkey").select(F.col("c_custkey").alias("viewer"), "videos")
    alone = o.filter("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return shared.union(alone.groupBy(F.col("o_custkey").alias("viewer")).agg(F.count_distinct("o_orderkey").alias("videos")))


@Q("SELECT o_orderkey AS tuple_id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def j14_roles(spark, folder):
    c = table(spark, folder, "customer").filter("c_acctbal > 0")
    return table(spark, folder, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("tuple_id"), F.col("c_name").alias("name"))


@Q("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'candidate' WHEN l.quality = 1 THEN 'override' ELSE d.lang END AS text FROM documents d LEFT JOIN labels l USING (doc_id)")
def j17_override(spark, folder):
    """A fragment's text: candidate, else override, else what is built in."""
    labels = table(spark, folder, "labels")
    candidate = labels.filter("toxic = 1").select("doc_id", F.lit("candidate").alias("c"))
    override = labels.filter("quality = 1").select("doc_id", F.lit("override").alias("o"))
    return table(spark, folder, "documents").join(candidate, "doc_id", "left").join(override, "doc_id", "left").select("doc_id", F.coalesce("c", "o", "lang").alias("text"))


@Q("SELECT o_orderkey, coalesce(a.c_name, b.n_name) AS matched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) a ON o_custkey = a.c_custkey LEFT JOIN nation b ON o_orderkey % 40 = b.n_nationkey")
def j18_match(spark, folder):
    """By one key, else by another: two equality joins."""
    first = table(spark, folder, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("matched"))
    second = table(spark, folder, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("matched"))
    return joins.priority_match(table(spark, folder, "orders"), F.col("o_custkey"), F.col("o_orderkey") % 40, first, second, "matched").select("o_orderkey", "matched")


@Q(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), a AS (SELECT * FROM l WHERE doc_id % 2 = 0), b AS (SELECT * FROM l WHERE doc_id % 2 = 1)
SELECT 'removed' AS side, doc_id, md5(line) AS line FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.line = a.line)
UNION ALL SELECT 'added', doc_id, md5(line) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.line = b.line)"""
)
def u03_line_diff(spark, folder):
    """Lines of one side that the other lacks, repeated ones kept: anti joins, since EXCEPT would drop them."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    a, b = lines.filter("doc_id % 2 = 0"), lines.filter("doc_id % 2 = 1")
    gone, new = a.join(b.select("line").distinct(), "line", "left_anti"), b.join(a.select("line").distinct(), "line", "left_anti")
    told = lambda df, side: df.select(F.lit(side).alias("side"), "doc_id", F.md5("line").alias("line"))
    return told(gone, "removed").union(told(new, "added"))


@Q("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def t10_page(spark, folder):
    return table(spark, folder, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(20).limit(10).select("o_orderkey", "o_custkey")


@Q("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') OR contains(c_custkey::VARCHAR, '00001') OR contains(lower(c_mktsegment), '00001')")
def p10_search(spark, folder):
    """A search over the id and the names."""
    c = table(spark, folder, "customer")
    return c.filter(checks.mentions(" 00001", c.c_custkey, c.c_name, c.c_mktsegment)).select("c_custkey", "c_name")


@Q("SELECT c_custkey FROM customer")
def p10_search_blank(spark, folder):
    """A blank search finds all."""
    c = table(spark, folder, "customer")
    return c.filter(checks.mentions("  ", c.c_name)).select("c_custkey")


@Q("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT = 69")
def p12_notification(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k = 69")


@Q("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS alarms, count(*) FILTER (WHERE event_type = 'purchase') AS warnings, count(*) AS n FROM events GROUP BY user_id")
def a27_alert_counters(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("alarms"), F.count_if(kind == "purchase").alias("warnings"), F.count("*").alias("n"))


@Q("SELECT c_mktsegment AS variant, s AS size, count(*) AS n FROM customer, (VALUES (120), (260)) v(s) GROUP BY ALL")
def u06_cross_product(spark, folder):
    sizes = spark.createDataFrame([(120,), (260,)], "size int")
    return table(spark, folder, "customer").crossJoin(F.broadcast(sizes)).groupBy(F.col("c_mktsegment").alias("variant"), "size").agg(F.count("*").alias("n"))


@Q("SELECT o_custkey AS c_custkey, string_agg('- ' || o_orderkey || ' (' || o_orderstatus || '): ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS tools FROM orders GROUP BY o_custkey")
def f33_tool_list(spark, folder):
    part = F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("text"))
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(part)).alias("l"))
    return rows.select("c_custkey", text.listed(F.col("l")).alias("tools"))

