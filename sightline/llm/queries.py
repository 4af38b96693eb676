"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .decontaminate import contamination
from .divergence import source_divergence
from .html_text import main_text
from .jaccard import near_duplicates
from .languages import language_id
from .licenses import license_digest, license_scan
from .packing import pack
from .quality import quality
from .secrets import secret_digest, secret_scan
from .sharding import keyed, reshard, rewrite_affected
from .tables import shared_folder, table
from .token_counts import token_counts
from .urls import url_filter


def op1_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_digest(license_scan(table(spark, folder, "documents")))


def op2_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """A source owns its documents; what it holds in one language is a repository."""
    return secret_digest(secret_scan(table(spark, folder, "documents"), F.col("source"), F.concat_ws("/", "source", "lang")))


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


#: op6's old layout: 32 shards by source, so one of them holds a third of all rows.
_OLD_SHARD = "cast(pmod(xxhash64(coalesce(source, '')), 32) as int)"


def op6_min_cost_flow_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = reshard(table(spark, folder, "documents"), F.expr(_OLD_SHARD))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids, (F.col("n_hit") > 0).alias("contaminated"))


def op8_karmarkar_karp_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter(table(spark, folder, "pages"))


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(table(spark, folder, "documents"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(table(spark, folder, "documents"))


def rewrite6_min_cost_flow_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """op6's last step: documents in files by their old shard, resharded, and the files of affected shards rewritten; what is in
    them then."""
    layout = f"{shared_folder(spark)}/sightline-layout-{uuid.uuid4().hex}"
    table(spark, folder, "documents").withColumn("shard", F.expr(_OLD_SHARD)).write.partitionBy("shard").parquet(layout)
    rows = keyed(spark.read.parquet(layout))
    rewrite_affected(rows, reshard(rows, F.col("shard")), layout)
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(layout).select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text).cast("long") + 16).alias("size"), "shard")


def base1_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """What op1 finds of the phrases asked for, which SQL can tell."""
    return op1_license_scans(spark, folder).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """op9's statistics and base rule, which SQL can tell."""
    return op9_quality_rules(spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """op10's hosts, paths and base rules, which SQL can tell; the verdict only where a base rule gives it."""
    return op10_url_filters(spark, folder).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("base_verdict"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans,
        op2_secret_scans,
        op3_html_extraction,
        op4_ngram_jaccard_join,
        op5_token_counts,
        op6_min_cost_flow_sharding,
        op7_benchmark_decontamination,
        op8_karmarkar_karp_packing,
        op9_quality_rules,
        op10_url_filters,
        op11_language_id,
        op12_source_divergence,
        op13_tokenizer_alignment,
        rewrite6_min_cost_flow_sharding,
        base1_license_scans,
        base9_quality_rules,
        base10_url_filters,
    )
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_SPACED = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"


def _phrase(words: str) -> str:
    """The places of a phrase in the list w."""
    test = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words.split(), 1))
    return f"[i FOR i IN range(len(w)) IF {test}]"


#: The operators whose whole result SQL can tell, and the base columns of others; tests hold the rest against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER.format("text"))} AS w FROM documents),
e AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(g) AS n FROM d LEFT JOIN e USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.reached)
SELECT r.doc_id, any_value(n.n)::BIGINT AS n_shingles, min(reached) AS component_id FROM r JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op7_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
wi AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
wd AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, wd.k FROM wd JOIN wi USING (win, k)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + unnest(range(k)) AS at FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_source_divergence": f"""WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k, regexp_extract_all({_LOWER.format("text")}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
t AS MATERIALIZED (SELECT lang, source, k, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, g.source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (kept.n + 2) // (v.n + 2 * v.v) AS q FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
u AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10""",
    "base1_license_scans": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), f AS (SELECT doc_id, len(w) AS n, {_phrase("cc by")} AS a, {_phrase("general public license")} AS b, {_phrase("all rights reserved")} AS c FROM d)
SELECT doc_id, n::BIGINT AS n_words, (len(a) + len(b) + len(c))::BIGINT AS n_base, list_min(list_concat(a, b, c))::BIGINT AS first_word, list_max(list_concat(a, b, c))::BIGINT AS last_word,
 concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels FROM f""",
    "base9_quality_rules": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(3)) AS at FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s""",
    "base10_url_filters": f"""WITH p AS (SELECT page_id, {_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, b) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT p.*, h || b AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || b) DESC NULLS LAST) AS nth FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b))
SELECT page_id, host, path, rule, verdict AS base_verdict FROM m WHERE nth = 1""",
}
