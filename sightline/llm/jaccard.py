"""Near duplicates by an exact Jaccard join of word shingles with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles. Equal sets are one node. Under one global order of shingles, rare
ones first, two sets of similarity t share at least l of their first (n - ceil(t * n) + l) shingles, for every l: each
set takes the l for which the estimated work is least. For a pair, whose sizes say how much it must share, the prefixes
are shorter still, and it is verified only if it shares as many shingles of them as the smaller l of the two asks for.

Only whether sets are connected matters, so groups of near copies are first tied to few common leaders (sets that
share a minimum hash; every tie is verified exactly). The prefix join then looks only at pairs that are not connected
yet: a shingle whose sets are all of one component gives no pairs, and in the others the largest component's sets meet
only the rest. No pair of a group of n copies needs n * n rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, Words, mix, ngrams, signed, text_chunks
from .components import connected_components
from .tables import bit_filter, cut, few_tasks, giving_back, in_filter, in_small_batches, joined_by_key, settle, small_or_shuffled

_U = np.uint64
#: Places of the shingle frequency sketch: 512 KB on the driver and on each executor, whatever the input.
SKETCH = 1 << 16
#: Minimum hashes for the first ties, and how many of them a tie must have in common.
HASHES = 6
TIE_HASHES = 2
#: Largest number of prefix shingles that a pair is asked to share.
MOST_SHARED = 16
#: Expected partners on the list of a shingle that does not stand out.
CHANCE = 0.1
#: Work of one verification, in prefix rows.
VERIFY_COST = 20.0
#: Sets of one shingle's list that one block of it holds.
LIST_BLOCK = 1_000
#: A set is a common one if it stands in more pairs than this, and in more than one in COMMON_SETS of all places of pairs.
COMMON_PAIRS = 128
COMMON_SETS = 8_192
#: Most shingles of common sets that are broadcast, all together (64 MB); one set may have a sixteenth of them.
COMMON_SHINGLES = 1 << 23


def _sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sets one after another, each sorted, and their bounds."""
    hashes = words.hashes()
    grams, first = ngrams(hashes, k), words.first
    out, bounds = [], np.zeros(len(first), np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = ngrams(hashes[a:b], b - a)
        else:
            own = np.zeros(0, _U)
        out.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, _U)), bounds


def _signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set, 0 for an empty one."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), _U)
    if len(full):
        at = bounds[:-1][full]
        out[full] = mix(np.add.reduceat(mix(tokens ^ _U(0xA5A5A5A5A5A5A5A5)), at) ^ mix(np.bitwise_xor.reduceat(tokens, at)) + sizes[full].astype(_U))
    return out


def _chunk_sets(batches: Iterator[pa.RecordBatch], k: int, wanted=None):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        if wanted is not None:
            keep = wanted(ids)
            if not keep.any():
                continue
            mask = pa.array(keep)
            ids, texts = ids.filter(mask), texts.filter(mask)
        for a, b, data, offsets in text_chunks(texts):
            tokens, bounds = _sets(Words(data, offsets, NOT_SPACE, lower=True), k)
            yield ids.slice(a, b - a), tokens, bounds, _signatures(tokens, bounds)


def _summaries(k: int):
    seeds = mix(np.arange(1, HASHES + 1, dtype=_U))

    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)
        for ids, tokens, bounds, signs in _chunk_sets(batches, k):
            sketch += np.bincount((tokens & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            least = np.zeros((len(sizes), HASHES), np.int64)
            for j, seed in enumerate(seeds):
                if len(full):
                    least[full, j] = signed(np.minimum.reduceat(mix(tokens ^ seed), bounds[:-1][full]))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(signed(signs)), pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, HASHES, dtype=np.int32)), pa.array(least.ravel())), pa.nulls(len(ids), pa.list_(pa.int64()))],
                names=["doc_id", "n", "node", "least", "sketch"],
            )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([sketch.tolist()], pa.list_(pa.int64()))], names=["doc_id", "n", "node", "least", "sketch"])

    return run


def _wanted(id_filter: np.ndarray):
    return lambda ids: in_filter(id_filter, mix(np.asarray(ids.fill_null(0).cast(pa.int64())).view(_U)))


def _stands_out(counts: np.ndarray) -> np.ndarray:
    """By how much each place of the sketch is over what it holds by chance, which says nothing about a shingle."""
    return np.maximum(counts - np.int64(counts.mean() + 4 * np.sqrt(counts.mean() + 1)), 0)


def _uncommon_rows(k: int, sketch, id_filter: np.ndarray, node_filter: np.ndarray):
    """(node, uncommon): how many shingles of a set do not stand out."""

    def run(batches):
        common = _stands_out(sketch.value) > 0
        for _, tokens, bounds, signs in _chunk_sets(batches, k, _wanted(id_filter)):
            total = np.concatenate(([0], np.cumsum(~common[(tokens & _U(SKETCH - 1)).astype(np.int64)])))
            keep = np.flatnonzero(in_filter(node_filter, signs) & (np.diff(bounds) > 0))
            yield pa.RecordBatch.from_arrays([pa.array(signed(signs[keep])), pa.array((total[bounds[1:]] - total[bounds[:-1]])[keep])], names=["node", "uncommon"])

    return run


def _set_rows(k: int, id_filter: np.ndarray, node_filter: np.ndarray):
    def run(batches):
        for _, tokens, bounds, signs in _chunk_sets(batches, k, _wanted(id_filter)):
            keep = np.flatnonzero(in_filter(node_filter, signs) & (np.diff(bounds) > 0))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(signed(signs[keep])), pa.array([tokens[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary())], names=["node", "tokens"])

    return run


def prefix_length(n: np.ndarray | int, shared: np.ndarray | int, threshold: Fraction) -> np.ndarray | int:
    """How many of a set's first shingles hold at least `shared` of those of any set that is similar enough."""
    p, q = threshold.numerator, threshold.denominator
    return np.minimum(n, n - -(-n * p // q) + shared)


def choose_shared(frequency: np.ndarray, n: int, threshold: Fraction) -> int:
    """The number of shared prefix shingles with the least estimated work for one set; frequency follows the global order
    and is 0 for shingles that do not stand out.

    A longer prefix adds its posting lists to what is read. Asking for l matches leaves about 1/l**2 of the candidates
    that meet by chance; documents that share a very common shingle share its neighbours too, so common lists are not
    thinned and a prefix that reaches them is kept short. A set can't be asked for more than its least partner shares.
    """
    most = max(1, min(MOST_SHARED, int(-(-n * threshold.numerator // threshold.denominator))))
    asked = np.arange(1, most + 1)
    length = prefix_length(n, asked, threshold)
    common = np.concatenate(([0.0], np.cumsum(frequency)))[length]
    often = np.concatenate(([0], np.cumsum(frequency > 0)))[length]
    chance = CHANCE * (length - often)
    work = common + chance + VERIFY_COST * (chance / asked**2 + common / np.maximum(often, 1))
    return int(asked[np.argmin(work)])


def _prefix_rows(k: int, threshold: Fraction, sketch, token_filter=None):
    """(token, node, n, place, shared) of each document's prefix; with a filter, only tokens in it."""

    def run(batches):
        excess = _stands_out(sketch.value)
        mixed = token_filter.value if token_filter is not None else None
        for _, tokens, bounds, signs in _chunk_sets(batches, k):
            parts = []
            frequency = excess[(tokens & _U(SKETCH - 1)).astype(np.int64)]
            for i in range(len(signs)):
                a, b = bounds[i], bounds[i + 1]
                n = int(b - a)
                if not n:
                    continue
                own, often = tokens[a:b], frequency[a:b]
                if often.any():
                    order = np.argsort(often, kind="stable")
                    own, often = own[order], often[order]
                shared = choose_shared(often, n, threshold)
                own = own[: prefix_length(n, shared, threshold)]
                places = np.arange(len(own), dtype=np.int32)
                if mixed is not None:
                    keep = in_filter(mixed, own)
                    own, places = own[keep], places[keep]
                if len(own):
                    parts.append((own, np.full(len(own), signs[i]), np.full(len(own), n, np.int32), places, np.full(len(own), shared, np.int32)))
            if parts:
                token, node, n, place, shared = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(signed(node)), pa.array(n), pa.array(place), pa.array(shared)], names=["token", "node", "n", "place", "shared"])

    return run


def _verify(threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("left_tokens"), batch.column("right_tokens")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_py(), _U), np.frombuffer(right[i].as_py(), _U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[i] = q * both >= p * (len(x) + len(y) - both)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _common_sets(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node) of sets that very many of the pairs have, those with most pairs first, as far as COMMON_SHINGLES reaches.

    There are fewer than COMMON_SETS of them before that sum is taken.
    """
    often = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs"))
    often = often.filter(F.col("pairs") > max(COMMON_PAIRS, 2 * pairs.count() // COMMON_SETS))
    sized = nodes.join(F.broadcast(often), "node").filter(F.col("n") <= COMMON_SHINGLES // 16)
    so_far = F.sum("n").over(Window.orderBy(F.col("pairs").desc(), "node").rowsBetween(Window.unboundedPreceding, 0))
    return cut(sized.select("node", so_far.alias("shingles")).filter(F.col("shingles") <= COMMON_SHINGLES).select("node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: two rows are linked when their sets' Jaccard similarity
    is threshold or more; component_id is the least id that links reach.

    Null, empty and blank texts have an empty set, no links and their own id; fewer words than k are one shingle.
    Repeated rows come back once each, a repeated id with several texts once for each text. Ids are whole numbers; null
    ids stay null unless linked with others. Other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = cut(docs.mapInArrow(giving_back(_summaries(k)), "doc_id long, n long, node long, least array<long>, sketch array<long>"))
    counts = np.zeros(SKETCH, np.int64)
    places = read.filter("n = -1").select(F.posexplode("sketch").alias("place", "number")).groupBy("place").agg(F.sum("number").alias("number")).filter("number > 0")
    places = places.toArrow()
    counts[places["place"].to_numpy()] = places["number"].to_numpy()
    sketch = spark.sparkContext.broadcast(counts)
    own = read.filter("n >= 0").select("doc_id", "n", "node", "least")
    nodes = cut(own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("least").alias("least")))

    def filters(needed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Bit sets of one document's id for each node of needed, and of the nodes."""
        ids = needed.join(nodes, "node").select(F.col("least_id").alias("id"))
        return bit_filter(ids.mapInArrow(_hashed, "id long"), "id"), bit_filter(needed, "node")

    def sets_of(needed: DataFrame) -> DataFrame:
        return docs.mapInArrow(giving_back(_set_rows(k, *filters(needed))), "node long, tokens binary").dropDuplicates(["node"])

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) that are linked; sets are worked out again for the nodes concerned alone.

        Pairs of a common set (a leader's of a large group) stay where they are: that set is broadcast, so they don't meet
        in one task. All others are joined by shuffles.
        """
        pairs = cut(pairs)
        pairs = few_tasks(pairs, pairs.count())
        common = _common_sets(pairs, nodes)
        sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        left = lambda s: s.select(F.col("node").alias("u"), F.col("tokens").alias("left_tokens"))
        right = lambda s: s.select(F.col("node").alias("v"), F.col("tokens").alias("right_tokens"))
        if common.isEmpty():
            # one shuffle by node, which both joins read
            rows = pairs.join(left(sets), "u").join(right(sets), "v")
        else:
            known = F.broadcast(cut(sets_of(common).join(F.broadcast(common), "node", "left_semi")))
            for side in ("u", "v"):
                flag = F.broadcast(common.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_common")))
                pairs = pairs.join(flag, side, "left").fillna(False, [f"{side}_common"])
            # of a pair with one common set, that one is v
            turned = pairs.select(F.when(F.col("v_common"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("v_common"), F.col("v")).otherwise(F.col("u")).alias("v"), (F.col("u_common").cast("int") + F.col("v_common").cast("int")).alias("commons"))
            rows = turned.filter("commons = 0").join(left(sets), "u").join(right(sets), "v")
            rows = rows.unionByName(turned.filter("commons = 1").join(left(sets), "u").join(right(known), "v"))
            rows = rows.unionByName(turned.filter("commons = 2").join(left(known), "u").join(right(known), "v"))
        return cut(rows.select("u", "v", "left_tokens", "right_tokens").mapInArrow(giving_back(_verify(threshold)), "u long, v long"))

    # Ties: sets with an equal minimum hash and the most ordinary one of them. Copies differ from their source by shingles
    # of their own, so the set with the fewest uncommon shingles is near the middle of its group and ties most of it.
    keys = nodes.select("node", F.posexplode("least").alias("place", "hash")).select("node", F.xxhash64("place", "hash").alias("key"))
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    keys = cut(joined_by_key(keys, sizes, "key", "size").select("node", "key"))
    grouped = keys.select("node").distinct()
    uncommon = docs.mapInArrow(giving_back(_uncommon_rows(k, sketch, *filters(grouped))), "node long, uncommon long").groupBy("node").agg(F.min("uncommon").alias("uncommon"))
    leaders = keys.join(uncommon, "node").groupBy("key").agg(F.min_by("node", F.struct("uncommon", "node")).alias("leader"), F.count("*").alias("size"))
    ties = joined_by_key(keys, cut(leaders), "key", "size").filter("node <> leader")
    ties = ties.groupBy(F.col("node").alias("u"), F.col("leader").alias("v")).count().filter(f"count >= {TIE_HASHES}").select("u", "v")
    ties = verified(ties)
    settle(spark)
    labels = cut(connected_components(ties))
    settle(spark)

    # The prefix join over pairs that are not connected yet.
    rows = "token long, node long, n int, place int, shared int"
    entries = docs.mapInArrow(giving_back(_prefix_rows(k, threshold, sketch)), rows).select("token", "node")
    label = _label_of(entries, labels)
    mixed = label.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("token")
    token_filter = spark.sparkContext.broadcast(bit_filter(mixed, "token", bits=25))
    entries = docs.mapInArrow(giving_back(_prefix_rows(k, threshold, sketch, token_filter)), rows).dropDuplicates(["token", "node"])
    entries = cut(_label_of(entries, labels, "n", "place", "shared"))
    sizes = entries.groupBy("token", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count("*").alias("labels"), F.sum("size").alias("size")).filter("labels > 1").select("token", "largest", "size")
    listed = cut(joined_by_key(entries, cut(largest), "token", "size"))
    # a long list is dealt to blocks, each of which meets all of the rest
    blocks = F.expr(f"cast(1 + size div {LIST_BLOCK} as int)")
    rest = listed.filter("label <> largest").select("token", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *[F.col(c).alias(f"o_{c}") for c in ("node", "label", "n", "place", "shared")])
    listed = listed.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    p, q = threshold.numerator, threshold.denominator
    pairs = rest.join(listed, ["token", "block"]).filter(
        # each pair once: the rest meet the largest, and one another in one order
        "o_label <> label and (label = largest or o_node < node)"
        f" and {q} * n >= {p} * o_n and {q} * o_n >= {p} * n"
        # within the prefixes that these two sizes need
        f" and greatest(place - n, o_place - o_n) < least(shared, o_shared) - ceil({p} * (n + o_n) / {p + q})"
        # what can be shared from these places on
        f" and {p + q} * (1 + least(n - place - 1, o_n - o_place - 1) + least(place, o_place)) >= {p} * (n + o_n)"
    )
    pairs = pairs.select(F.least("o_node", "node").alias("u"), F.greatest("o_node", "node").alias("v"), F.least("o_shared", "shared").alias("asked"))
    pairs = pairs.groupBy("u", "v", "asked").agg(F.count("*").alias("found")).filter("found >= asked").select("u", "v")
    links = verified(pairs)
    settle(spark)
    found = cut(connected_components(ties.union(links)))
    settle(spark)

    # The least id of each component, then of each document.
    named = cut(nodes.select("node", "least_id").join(found, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size")))
    answer = cut(joined_by_key(named, least, "component", "size").select("node", "component_id"))
    many = own.filter("n > 0").select("doc_id", "n", "node").join(answer, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return many.union(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _hashed(batches):
    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(0)).view(_U)
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(ids)))], names=["id"])


def _label_of(entries: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """Entries with their node's component so far (the node itself if none). Only tied nodes are in labels.

    A small table of labels is broadcast; a larger one is joined by a shuffle.
    """
    labels = small_or_shuffled(labels)
    return entries.join(labels, entries["node"] == labels["node"], "left").select(entries["token"], entries["node"], *[entries[c] for c in more], F.coalesce(labels["component"], entries["node"]).alias("label"))
