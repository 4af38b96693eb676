"""Secret scan with corpus-wide ownership, in DataFrame expressions alone.

Candidates are found by pattern in each text; their values' hashes are counted over the corpus by distinct repositories
and owners. A value that many owners hold, or a few owners in many repositories, is a copied example; one that a single
owner holds looks live, in however many of the owner's repositories it is. Base kinds are reported either way; the
further kinds only where they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, joined_by_key, unused

# Base kinds in their order, (kind, pattern, least length, group that the length and the value are of).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
)
# Further kinds, with a string that each holds.
MORE = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{20,}", "gh"),
    ("google", r"AIza[0-9A-Za-z_-]{35}", "AIza"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    ("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", "PRIVATE KEY-----"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", "k_live_"),
)
KINDS = tuple(k for k, *_ in BASE + MORE)
#: A value held by this many owners or more is a copied example,
EXAMPLE_OWNERS = 3
#: and so is one of two owners or more that is in this many repositories or more.
EXAMPLE_REPOSITORIES = 6
#: Code points of the blocks that a text is cut into before parts of it are taken.
BLOCK = 256

_SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint,hash:string,live:boolean,owners:bigint,repositories:bigint>"


def _may_hold(kind: str, text: Column) -> Column:
    """Cheaper than the pattern, and true wherever it matches."""
    if kind == "assign":
        low = F.lower(text)
        return low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    if kind == "access":
        return text.contains("AKIA")
    if kind == "hex":
        return text.rlike(r"[0-9a-f]{32}")
    return text.contains(next(x for k, _, x in MORE if k == kind))


def may_hold_secrets(text: Column) -> Column:
    out = F.lit(False)
    for kind in KINDS:
        out = out | _may_hold(kind, text)
    return F.coalesce(out, F.lit(False))


def _steps(text: Column, kind: str, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: how long the gap before each is, how long the match, and its value's hash (null
    if the value is too short). Lengths are in code points; their running sum gives the places."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), group)
    steps = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), value.alias("value")), lambda x: x["match"].isNotNull())
    hashed = lambda x: F.when(F.length(x["value"]) >= least, F.sha2(x["value"], 256))
    own = F.transform(steps, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("match"), hashed(x).alias("hash")))
    return F.when(_may_hold(kind, text), own).otherwise(F.expr("cast(array() as array<struct<rank:int,gap:int,match:int,hash:string>>)"))


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(uid, doc_id, same, owner, repository, steps) for each row, written once."""
    text = F.coalesce("text", F.lit(""))
    steps = F.concat(*[_steps(text, *b) for b in BASE], *[_steps(text, kind, pattern) for kind, pattern, _ in MORE])
    rows = docs.select("doc_id", F.xxhash64("text").alias("same"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), steps.alias("steps"))
    return cut(rows).withColumn("uid", F.monotonically_increasing_id())


def placed(found: DataFrame) -> DataFrame:
    """(uid, owner, repository, hash, rank, start, stop) for each span: places are a running sum over the row's matches of a kind."""
    steps = found.select("uid", "owner", "repository", F.posexplode("steps").alias("place", "step")).select("uid", "owner", "repository", "place", "step.*")
    line = Window.partitionBy("uid", "rank").orderBy("place")
    stop = F.sum(F.col("gap").cast("long") + F.col("match")).over(line)
    return steps.withColumn("stop", stop).filter("hash is not null").select("uid", "owner", "repository", "hash", "rank", (F.col("stop") - F.col("match")).alias("start"), "stop")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, spans, repositories, owners): how many distinct ones hold each value. Null owners and repositories count as one each."""
    pairs = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("spans"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("spans").alias("spans"), F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.sum("spans").alias("spans"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def secret_scan(docs: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(doc_id, same, base, spans) for each row of docs (doc_id, text and what owner and repository are made of).

    base and spans are arrays of structs (start, rank, kind, stop, hash, live, owners, repositories) by start, then kind;
    base are those of the base kinds. live is false from example_owners owners on, and for two owners or more from
    example_repositories repositories on. Places are in code points, end exclusive; same is the text's hash. Null and empty
    texts have none; repeated rows come back once each; other columns are ignored; an empty table gives no rows.
    """
    found = candidates(docs, owner, repository)
    spans = cut(placed(found.filter("size(steps) > 0")))
    counts = cut(ownership(spans))
    counted = joined_by_key(spans.select("uid", "hash", "rank", "start", "stop"), counts, "hash", "spans")
    live = (F.col("owners") < example_owners) & ((F.col("owners") < 2) | (F.col("repositories") < example_repositories))
    judged = counted.withColumn("live", live).filter((F.col("rank") < len(BASE)) | F.col("live"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    span = F.struct("start", "rank", kind.alias("kind"), "stop", "hash", "live", "owners", "repositories")
    judged = judged.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = F.coalesce("spans", F.expr(f"cast(array() as array<{_SPAN}>)"))
    return found.select("doc_id", "same", "uid").join(judged, "uid", "left").select("doc_id", "same", F.filter(spans, lambda s: s["rank"] < len(BASE)).alias("base"), spans.alias("spans"))


def _told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(_told("base"), 256).alias("base_sha256"),
        _told("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def masked_ranges(scanned: DataFrame) -> DataFrame:
    """(doc_id, same, ranges) for texts with spans: overlapping spans as one range, each with the end of the one before it."""
    spans = scanned.filter("size(spans) > 0").dropDuplicates(["doc_id", "same"]).select("doc_id", "same", F.posexplode("spans").alias("place", "s"))
    line = Window.partitionBy("doc_id", "same").orderBy("place")
    before = F.coalesce(F.max("s.stop").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    spans = spans.withColumn("before", before).withColumn("range", F.sum((F.col("s.start") >= F.col("before")).cast("int")).over(line))
    ranges = spans.groupBy("doc_id", "same", "range").agg(F.min("before").alias("before"), F.min("s.start").alias("start"), F.max("s.stop").alias("stop"))
    return ranges.groupBy("doc_id", "same").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "before"))).alias("ranges"))


def _part(blocks: Column, start: Column, stop: Column) -> Column:
    """The text from start to stop (code points), out of the blocks that hold it."""
    first = F.floor(start / BLOCK)
    own = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.floor((stop - 1) / BLOCK) - first + 1).cast("int")), "")
    return F.when(stop > start, F.substring(own, (start - first * BLOCK + 1).cast("int"), (stop - start).cast("int"))).otherwise(F.lit(""))


def redact(docs: DataFrame, scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of secret_scan() replaced by mask (overlapping spans by one) and n_chars, if there, counted anew.

    Rows that cannot hold a secret pass by; only the others are joined with their spans. Work grows with a text's length
    and its number of spans, not with their product. Columns of docs may have any names.
    """
    suspect = may_hold_secrets(F.col("text"))
    r_doc, r_same, r_ranges = unused(docs, "r_doc", "r_same", "r_ranges")
    ranges = masked_ranges(scanned).select(F.col("doc_id").alias(r_doc), F.col("same").alias(r_same), F.col("ranges").alias(r_ranges))
    hit = docs.filter(suspect).join(ranges, F.col("doc_id").eqNullSafe(F.col(r_doc)) & (F.xxhash64("text") == F.col(r_same)), "left")
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), 0)
    end = F.length("text").cast("long")

    def masked(blocks: Column) -> Column:
        parts = F.transform(r_ranges, lambda x: F.concat(_part(blocks, x["before"], x["start"]), F.lit(mask)))
        return F.concat(F.array_join(parts, ""), _part(blocks, F.element_at(r_ranges, -1)["stop"], end))

    # a lambda's argument is worked out once for all of a text's parts
    text = F.element_at(F.transform(F.array(blocks), masked), 1)
    untouched = F.col(r_ranges).isNull()
    hit = hit.withColumn("text", F.when(untouched, F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return docs.filter(~suspect).unionByName(hit.select(*docs.columns))
