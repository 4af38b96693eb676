"""Prompts put together from fragments, overrides and a context, for many contexts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import content_hash, placeholders, untrusted


def resolved(fragments: DataFrame, overrides: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """fragments (agent, fragment, editable, text) with the text that counts: a candidate, else an override, else their own.

    Only editable fragments take another text.
    """
    keys = ["agent", "fragment"]
    out = fragments.join(overrides.select(*keys, F.col("text").alias("_o")), keys, "left")
    if candidates is not None:
        out = out.join(candidates.select(*keys, F.col("text").alias("_c")), keys, "left")
    else:
        out = out.withColumn("_c", F.lit(None).cast("string"))
    return out.withColumn("text", F.coalesce(F.when(F.col("editable"), F.coalesce("_c", "_o")), "text")).drop("_o", "_c")


def glued(parts: Column) -> Column:
    """Texts joined by a blank line; one that begins with a blank or a line end follows directly. Null ones are left out.

    Separators are put before the texts and all is joined at once; a fold would copy the growing text at each step. Empty
    texts before the first with characters are left out beforehand, so that no text has to look for it among the others.
    """
    told = F.filter(parts, lambda x: x.isNotNull())
    first = F.array_position(F.transform(told, lambda x: F.length(x) > 0), True)
    said = F.slice(told, F.greatest(first, F.lit(1)).cast("int"), F.size(told))
    joined = F.array_join(F.transform(said, lambda x, i: F.when((i == 0) | x.rlike("^[ \n]"), x).otherwise(F.concat(F.lit("\n\n"), x))), "")
    return F.when(first == 0, "").otherwise(joined)


def rendered(kinds: DataFrame, fragments: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context_id, kind, prefix, suffix, digest, missing) for kinds (kind, agent, fragment, pos, part: prefix or suffix, needs)
    and contexts (context_id, kind, values: map).

    A fragment with a needs name is left out where the context has no such value. Values are outside text and are made
    harmless before they are filled in; missing lists the placeholders without a value.
    """
    wanted = contexts.join(F.broadcast(kinds), "kind").filter("needs is null or trim(coalesce(values[needs], '')) <> ''")
    rows = wanted.join(F.broadcast(fragments.select("agent", "fragment", "text")), ["agent", "fragment"])
    names = placeholders(F.col("text"))
    known = F.filter(names, lambda n: F.map_contains_key("values", n))
    filled = F.aggregate(known, F.col("text"), lambda out, n: F.replace(out, F.concat(F.lit("{"), n, F.lit("}")), untrusted(F.element_at("values", n))))
    rows = rows.withColumn("filled", filled).withColumn("lacking", F.array_except(names, F.map_keys("values")))
    parts = lambda part: glued(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("pos", "filled")))), lambda r: r["filled"]))
    out = rows.groupBy("context_id", "kind").agg(parts("prefix").alias("prefix"), parts("suffix").alias("suffix"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lacking")))).alias("missing"))
    return out.select("context_id", "kind", "prefix", "suffix", content_hash(F.col("prefix"), F.col("suffix")).alias("digest"), "missing")
