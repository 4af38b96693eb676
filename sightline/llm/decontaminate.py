"""Benchmark decontamination: which documents hold a whole window of words of a benchmark item, and where.

A window is 10 consecutive words of an item (all words of a shorter one). Its tokens are its overlapping 3-word
shingles. For exact containment the necessary prefix under a rarity order is one token, so each window is listed under
its rarest one, by frequency over all documents. A document looks up its own shingles in that list; a match says where
the window would begin, the document's bounds rule out windows that would not fit, and the remaining ones are compared
word for word.

Up to BROADCAST_WINDOWS windows are searched by one pass with a broadcast list. More are joined with the documents by
token: the corpus is read three times, however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, ngrams, signed, text_chunks
from .tables import bit_filter, cut, in_filter, in_small_batches

_U = np.uint64
#: Words of a token.
SHINGLE = 3
#: Most windows that are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Occurrences of one token that one task of the join meets; a token with more is dealt to several. At most DEALT_TOKENS
#: tokens are: with more occurrences in all, a task's share grows instead.
ROWS_A_TASK = 500_000
DEALT_TOKENS = 1 << 17


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0)
            for a, b, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets, ALNUM, lower=True)
                hashes, out, item = words.hashes(), [], []
                for i in range(b - a):
                    own = hashes[words.first[i] : words.first[i + 1]]
                    length = min(size, len(own))
                    for s in range(len(own) - length + 1 if length else 0):
                        out.append(own[s : s + length].tobytes())
                        item.append(a + i)
                yield pa.RecordBatch.from_arrays([items.take(pa.array(item, pa.int64())), pa.array(out, pa.binary())], names=["item", "words"])

    return run


def _by_length(windows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window numbers, their words, their tokens) for each length."""
    out = []
    lengths = np.array([len(w) // 8 for w in windows], np.int64)
    for length in np.unique(lengths):
        number = np.flatnonzero(lengths == length)
        words = np.frombuffer(b"".join(windows[i] for i in number), _U).reshape(len(number), length)
        q = min(SHINGLE, int(length))
        out.append((number, words, np.stack([ngrams_of(words[:, j : j + q]) for j in range(length - q + 1)], axis=1)))
    return out


class _Index:
    """Windows by word hashes, with the token that each is listed under."""

    def __init__(self, groups: list, items: list[list[str]], known: np.ndarray, counts: np.ndarray):
        self.items = items
        self.classes = []
        for number, words, tokens in groups:
            often = counts[np.searchsorted(known, tokens)]
            rarest = np.lexsort((tokens, often), axis=1)[:, 0]
            key = tokens[np.arange(len(tokens)), rarest]
            order = np.argsort(key, kind="stable")
            length = words.shape[1]
            self.classes.append((length, min(SHINGLE, length), key[order], rarest[order], words[order], number[order]))

    def hits(self, words: Words, hashes: np.ndarray, grams: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, window) of each place where a window stands."""
        found = []
        for length, q, keys, offset, wanted, number in self.classes:
            own = grams[q]
            left = np.searchsorted(keys, own, side="left")
            at = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == own) if len(keys) else np.zeros(0, np.int64)
            count = np.searchsorted(keys, own[at], side="right") - left[at]
            place = np.repeat(at, count)
            window = np.repeat(left[at], count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
            start = place - offset[window]
            doc = np.searchsorted(words.first, place, side="right") - 1
            fits = (start >= words.first[doc]) & (start + length <= words.first[doc + 1])
            start, window = start[fits], window[fits]
            for j in range(length):
                same = hashes[start + j] == wanted[window, j]
                start, window = start[same], window[same]
            found.append((start, np.full(len(start), length), number[window]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def ngrams_of(words: np.ndarray) -> np.ndarray:
    """ngrams() for each row of a matrix."""
    rows, k = words.shape
    return ngrams(np.ascontiguousarray(words).ravel(), k)[::k] if rows else np.zeros(0, _U)


def _counts(tokens, sizes):
    def run(batches):
        known = tokens.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                hashes = Words(data, offsets, ALNUM, lower=True).hashes()
                for q in sizes:
                    grams = ngrams(hashes, q)
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    total += np.bincount(at[known[at] == grams], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(signed(known[some])), pa.array(total[some])], names=["token", "number"])

    return run


_HITS = "doc_id {}, same long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"


def _search(index):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        known = index.value
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets, ALNUM, lower=True)
                hashes, first = words.hashes(), words.first
                grams = {q: ngrams(hashes, q) for q in {c[1] for c in known.classes}}
                start, length, window = known.hits(words, hashes, grams)
                edge = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                covered = np.cumsum(edge)[: len(hashes)] > 0
                total = np.concatenate(([0], np.cumsum(covered)))
                n_hit = total[first[1:]] - total[first[:-1]]
                rows = np.arange(b - a)
                doc = np.searchsorted(first, start, side="right") - 1
                spans, items = [None] * len(rows), [None] * len(rows)
                order = np.argsort(doc, kind="stable")
                bounds = np.searchsorted(doc[order], np.arange(b - a + 1))
                for k, i in enumerate(rows):
                    if not n_hit[i]:
                        spans[k], items[k] = [], []
                        continue
                    items[k] = sorted({x for w in np.unique(window[order[bounds[i] : bounds[i + 1]]]) for x in known.items[w]})
                    own = np.concatenate(([False], covered[first[i] : first[i + 1]], [False])).astype(np.int8)
                    change = np.flatnonzero(np.diff(own))
                    spans[k] = [{"start": int(x), "end": int(y)} for x, y in zip(change[::2], change[1::2])]
                take = pa.array(rows + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(words.counts[rows].astype(np.int64)), pa.array(n_hit[rows].astype(np.int64)), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "same", "n_words", "n_hit", "spans", "items"],
                )

    return run


def _window_tokens(batches):
    for batch in batches:
        windows = [w.as_py() for w in batch.column(0)]
        parts = [(np.repeat(number, tokens.shape[1]), tokens.ravel(), np.tile(np.arange(tokens.shape[1]), len(number))) for number, _, tokens in _by_length(windows)]
        for number, token, offset in parts:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number)), pa.array(signed(token)), pa.array(offset.astype(np.int32))], names=["words", "token", "offset"])


def _token_counts(places: np.ndarray, sizes: list[int]):
    """(token, number) of a chunk's tokens that the bit filter lets through."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words = Words(data, offsets, ALNUM, lower=True)
                _, token = _filtered(words, words.hashes(), places, sizes)
                token, number = np.unique(token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(number.astype(np.int64))], names=["token", "number"])

    return run


def _filtered(words: Words, hashes: np.ndarray, places: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (word numbers) and tokens that the bit filter lets through; a token lies within one document."""
    at, token = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for q in sizes:
        grams = ngrams(hashes, q)
        own = np.flatnonzero(in_filter(places, grams))
        own = own[own + q <= words.first[np.searchsorted(words.first, own, side="right")]]
        at.append(own)
        token.append(grams[own])
    return np.concatenate(at), np.concatenate(token)


def _occurrences(places: np.ndarray, sizes: list[int], size: int, dealt):
    """(doc_id, same, token, part, place, low, context) of each listed token's places; context is the words around it from low on."""

    def run(batches):
        heavy, parts = dealt.value
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets, ALNUM, lower=True)
                hashes, first = words.hashes(), words.first
                at, token = _filtered(words, hashes, places, sizes)
                doc = np.searchsorted(first, at, side="right") - 1
                low, high = np.maximum(first[doc], at - size + 1), np.minimum(first[doc + 1], at + size)
                part = np.zeros(len(at), np.int32)
                if len(heavy):
                    row = np.minimum(np.searchsorted(heavy, token), len(heavy) - 1)
                    much = heavy[row] == token
                    part[much] = (offsets[doc[much]] + at[much]) % parts[row[much]]
                context = pa.array([hashes[x:y].tobytes() for x, y in zip(low, high)], pa.binary())
                take = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(signed(token)), pa.array(part), pa.array(at - first[doc]), pa.array(low - first[doc]), context],
                    names=["doc_id", "same", "token", "part", "place", "low", "context"],
                )

    return run


def _joined(docs: DataFrame, windows: DataFrame, size: int, kind: str) -> DataFrame:
    """(doc_id, same, spans, items) of documents with windows, by a join on the windows' rarest tokens."""
    sizes = list(range(1, min(SHINGLE, size) + 1))
    tokens = cut(windows.select("words").mapInArrow(_window_tokens, "words binary, token long, offset int"))
    counts = docs.select("text").mapInArrow(_token_counts(bit_filter(tokens.select("token").distinct(), "token", bits=25), sizes), "token long, number long")
    counts = counts.groupBy("token").agg(F.sum("number").alias("number"))
    # a window with a token that no document holds is in none
    rarest = tokens.join(counts, "token", "left").withColumn("number", F.coalesce("number", F.lit(0)))
    rarest = rarest.groupBy("words").agg(F.min(F.struct("number", "token", "offset")).alias("r")).select("words", "r.*").filter("number > 0")
    listed = cut(rarest.join(windows, "words"))
    known = listed.select("token", "number").distinct()
    most = max(ROWS_A_TASK, (known.agg(F.sum("number")).first()[0] or 0) // DEALT_TOKENS)
    dealt = known.filter(F.col("number") > most).select("token", F.ceil(F.col("number") / most).cast("int").alias("parts")).toArrow()
    heavy, parts = dealt["token"].to_numpy().view(_U), dealt["parts"].to_numpy()
    order = np.argsort(heavy)
    found = docs.mapInArrow(
        _occurrences(bit_filter(known, "token", bits=25), sizes, size, docs.sparkSession.sparkContext.broadcast((heavy[order], parts[order]))),
        f"doc_id {kind}, same long, token long, part int, place long, low long, context binary",
    )
    listed = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("number") / most), F.lit(1)).cast("int") - 1)))
    hits = found.join(listed, ["token", "part"]).withColumn("start", F.col("place") - F.col("offset"))
    hits = hits.filter("start >= low and substring(context, cast(8 * (start - low) + 1 as int), octet_length(words)) = words")
    hits = cut(hits.select("doc_id", "same", "start", (F.col("start") + F.expr("octet_length(words) div 8")).alias("end"), "items"))
    # overlapping and touching ranges become one
    line = Window.partitionBy("doc_id", "same").orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("doc_id", "same", "start", "end").distinct().withColumn("fresh", (before.isNull() | (before < F.col("start"))).cast("int"))
    spans = spans.withColumn("range", F.sum("fresh").over(line)).groupBy("doc_id", "same", "range").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("doc_id", "same").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = hits.select("doc_id", "same", F.explode("items").alias("item")).distinct().groupBy("doc_id", "same").agg(F.array_sort(F.collect_list("item")).alias("items"))
    items = items.select(F.col("doc_id").alias("i_doc"), F.col("same").alias("i_same"), "items")
    return spans.join(items, F.col("doc_id").eqNullSafe(F.col("i_doc")) & F.col("same").eqNullSafe(F.col("i_same"))).drop("i_doc", "i_same")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, same, n_words, n_hit, spans, items) for each row of docs (doc_id, text) against benchmark (item_id, text).

    Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z in lower case. n_hit counts words inside any
    occurrence of a window, spans are their ranges (words from 0, end exclusive), items the ids with such windows as
    sorted strings. Null and empty texts have no words; an item without words, or without an id, has no windows; rows
    that repeat come back once each; other columns are ignored.

    Up to broadcast_windows distinct windows are broadcast; more are joined by a shuffle. What reaches the driver or is
    broadcast does not grow with the benchmark or the documents beyond that.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    hits_schema = _HITS.format(kind)
    docs = in_small_batches(docs).select("doc_id", F.xxhash64("text").alias("same"), "text")
    windows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null").mapInArrow(_windows(size), "item string, words binary")
    windows = cut(windows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")))
    number = windows.count()
    if number <= broadcast_windows:
        index = _index(docs, windows.collect()) if number else NOTHING
        return docs.mapInArrow(_search(spark.sparkContext.broadcast(index)), hits_schema)
    own = docs.mapInArrow(_search(spark.sparkContext.broadcast(NOTHING)), hits_schema).select("doc_id", "same", "n_words")
    hits = _joined(docs, windows, size, kind).select(F.col("doc_id").alias("h_doc"), F.col("same").alias("h_same"), F.col("spans").alias("h_spans"), F.col("items").alias("h_items"))
    out = own.join(hits, F.col("doc_id").eqNullSafe(F.col("h_doc")) & F.col("same").eqNullSafe(F.col("h_same")), "left")
    spans = F.coalesce("h_spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select("doc_id", "same", "n_words", n_hit.alias("n_hit"), spans.alias("spans"), F.coalesce("h_items", F.expr("cast(array() as array<string>)")).alias("items"))


def _index(docs: DataFrame, listed: list) -> _Index:
    """The broadcast list; its tokens' frequencies are counted over all documents."""
    groups = _by_length([bytes(r.words) for r in listed])
    known = np.unique(np.concatenate([tokens.ravel() for _, _, tokens in groups]))
    sizes = sorted({min(SHINGLE, words.shape[1]) for _, words, _ in groups})
    counted = docs.select("text").mapInArrow(_counts(docs.sparkSession.sparkContext.broadcast(known), sizes), "token long, number long")
    found = counted.groupBy("token").agg(F.sum("number").alias("number")).toArrow()
    counts = np.zeros(len(known), np.int64)
    counts[np.searchsorted(known, found["token"].to_numpy().view(_U))] = found["number"].to_numpy()
    return _Index(groups, [list(r["items"]) for r in listed], known, counts)


NOTHING = _Index([], [], np.zeros(0, _U), np.zeros(0, np.int64))
