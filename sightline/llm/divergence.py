"""How far the sources of a language differ in their words: exact divergences of all pairs of sources.

Words are counted by (lang, source); each language keeps those that enough of its documents hold. A source's counts are
packed by chunks of the vocabulary, the sources of a language are dealt to blocks, and each packed vector goes to the
tiles (block by block) that its block is part of. A tile works out its submatrix over one chunk after another, so it holds
one chunk of two blocks at a time; a large vocabulary is cut into spans of chunks, whose parts of a submatrix are added up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, in_small_batches, small_or_shuffled

#: Documents of a language that must hold a word, and best words that are told of a source.
LEAST_DOCS = 10
TOP_TERMS = 10
#: About how many sources share a block and words a chunk, and how many chunks one task works through.
BLOCK = 8
CHUNK = 1024
SPAN = 64
#: Counts that a task holds before it passes them on.
HELD = 400_000

_codes = np.arange(256)
_is_letter = (_codes >= 0x80) | ((_codes >= 0x41) & (_codes <= 0x5A)) | ((_codes >= 0x61) & (_codes <= 0x7A))
#: UTF-8 bytes: A-Z in lower case, ASCII without letters as spaces.
_WORD_BYTES = np.where(_is_letter, np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes), 0x20).astype(np.uint8).tobytes()
_COUNTED = "lang string, source string, term string, count long, docs long"


def _count_terms(batches):
    """(lang, source, term, count, docs) of a task's documents, a few times over if they have many different words."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def told():
        for (lang, source), (counts, docs) in found.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            same = lambda x, n=len(terms): pa.array([x] * n, pa.string())
            yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())], names=["lang", "source", "term", "count", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = text.as_buffer().to_pybytes().translate(_WORD_BYTES).split()
            if not words:
                continue
            counts, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(counts)
            counts.update(words)
            docs.update(set(words))
            held += len(counts)
            if held > HELD:
                yield from told()
                found.clear()
                held = 0
    yield from told()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(1000000000 * (count + 2) / total), three decimal digits at a time: exact below a total of 9 * 10 ** 15."""
    out, rest = F.lit(0).cast("long"), count + 2
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return out + 1


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64), counts + 2
    for _ in range(3):
        out = out * 1000 + rest * 1000 // totals
        rest = rest * 1000 % totals
    return out + 1


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over the last axis of floor((p - q) ** 2 / (p + q)), each row of p with each of q."""
    apart = p[:, None, :] - q[None, :, :]
    return (apart * apart // (p[:, None, :] + q[None, :, :])).sum(axis=2)


def _tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile's sums over one span: the heads name its sources, the other rows are their packed counts."""
    lang, a, b, _ = key
    heads = pdf[pdf["chunk"] < 0].sort_values(["block", "source"], ignore_index=True)
    row = {s: i for i, s in enumerate(heads["source"])}
    left, right = (np.flatnonzero(heads["block"].to_numpy() == x) for x in (a, b))
    sums, seen = np.zeros((len(left), len(right)), np.int64), 0
    totals, terms = heads["total"].to_numpy(np.int64)[:, None], int(heads["terms"].iloc[0])
    for _, part in pdf[pdf["chunk"] >= 0].groupby("chunk"):
        places = np.unique(np.concatenate(part["places"].to_list()))
        counts = np.zeros((len(heads), len(places)), np.int64)
        for source, at, n in zip(part["source"], part["places"], part["counts"]):
            counts[row[source], np.searchsorted(places, at)] = n
        shares = _shares(counts, totals)
        sums += _distances(shares[left], shares[right])
        seen += len(places)
    if terms > seen:  # words that none of these sources has
        shares = _shares(np.zeros((len(heads), 1), np.int64), totals)
        sums += (terms - seen) * _distances(shares[left], shares[right])
    i, j = np.triu_indices(len(left), 1) if a == b else (x.ravel() for x in np.indices(sums.shape))
    names = heads["source"].to_numpy()
    return pd.DataFrame({"lang": lang, "source": names[left[i]], "item": names[right[j]], "value": sums[i, j]})


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, count, in_lang, is_first) of words that at least least_docs documents of the language hold.

    in_lang is the word's count in the language; is_first marks one row of each word of a language.
    """
    counted = in_small_batches(docs).mapInArrow(_count_terms, _COUNTED)
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    all_of = Window.partitionBy("lang", "term")
    kept = counted.select("lang", "source", "term", "count", F.sum("docs").over(all_of).alias("docs"), F.sum("count").over(all_of).alias("in_lang"), (F.col("source") == F.min("source").over(all_of)).alias("is_first"))
    return kept.filter(F.col("docs") >= least_docs).drop("docs")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(lang, source, part, item, value, rank) for the sources of each language of docs (text, lang, source).

    A word's share in a source is 1 + floor(10 ** 9 * (count + 2) / (N + 2 * V)), with V kept words in the language and N of
    their occurrences in the source; likewise in the language. Part `pair` has each other source of the language and the
    sum of floor((p - q) ** 2 / (p + q)) over all kept words; part `term` the `top` words with the largest such values among
    those more frequent in the source than in the language. Ranks are by value, then by the item's bytes.

    Null text, lang and source are read as ''. A source without words takes part with N = 0; a language without kept words
    gives pairs of value 0, one with a single source no pairs. Repeated rows count as often as they occur; other columns
    are ignored; an empty table gives no rows.
    """
    slim = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut(kept_terms(slim, least_docs))
    langs = kept.filter("is_first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = slim.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    blocks = F.greatest(F.ceil(F.count("*").over(Window.partitionBy("lang")) / block), F.lit(1)).cast("int")
    v = F.coalesce("v", F.lit(0))
    groups = groups.select("lang", "source", (F.coalesce("n", F.lit(0)) + 2 * v).alias("total"), (F.coalesce("lang_n", F.lit(0)) + 2 * v).alias("lang_total"), F.greatest(F.ceil(v / chunk), F.lit(1)).cast("int").alias("chunks"), blocks.alias("blocks"))
    groups = cut(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))

    rows = kept.join(small_or_shuffled(groups), ["lang", "source"])
    best = rows.select("lang", "source", F.col("term").alias("item"), _share(F.col("count"), F.col("total")).alias("p"), _share(F.col("in_lang"), F.col("lang_total")).alias("q"))
    best = best.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    # words are numbered within their chunk, and a chunk's counts of one source are one row
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    numbered = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    packed = numbered.groupBy("lang", "chunk", "source", "block", "blocks").agg(F.collect_list(F.struct("place", "count")).alias("cells"))
    packed = packed.select("lang", "source", "block", "blocks", F.expr(f"chunk div {span}").cast("int").alias("span"), "chunk", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"), F.transform("cells", lambda x: x["place"]).alias("places"), F.transform("cells", lambda x: x["count"]).alias("counts"))
    in_span = rows.filter("is_first").groupBy("lang", F.expr(f"chunk div {span}").cast("int").alias("span")).agg(F.count("*").alias("terms"))
    heads = groups.withColumn("span", F.explode(F.sequence(F.lit(0), F.expr(f"(chunks - 1) div {span}").cast("int")))).join(in_span, ["lang", "span"], "left")
    heads = heads.select("lang", "source", "block", "blocks", "span", F.lit(-1).alias("chunk"), "total", F.coalesce("terms", F.lit(0)).alias("terms"), F.array().cast("array<int>").alias("places"), F.array().cast("array<bigint>").alias("counts"))
    tiles = packed.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("blocks", "other")
    pairs = tiles.groupBy("lang", "a", "b", "span").applyInPandas(_tile, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = best.withColumn("rank", rank).filter(F.col("rank") <= top).unionByName(pairs.withColumn("rank", rank))
    return out.select("lang", "source", "part", "item", "value", "rank")
