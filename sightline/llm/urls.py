"""URL filter by association rules, in DataFrame operations alone.

Labelled URLs become transactions of their tokens and their label; FP-growth finds the combinations that are frequent,
and those that imply a block with enough confidence and support become rules. A rule that a shorter one already implies
is pruned. Rules are matched by an inverted index: each is listed under its rarest token, so a URL meets only rules
that share that token with it. Base rules (host and path prefix) go before learned ones.

Labels come from example URLs, whose words alone seldom tell: most are found in wanted and in unwanted hosts, so that it is
their combinations that imply a block. Other labels can be given instead.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import ascii_lower, cut, small_or_shuffled

# The base rules (verdict, host, path).
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Names of labelled example hosts, unwanted and wanted.
BLOCKED_NAMES = """casino-win-cash big-win-casino casino-bonus-spins online-casino-bonus free-casino-spins casino-jackpot-win lottery-win-cash win-jackpot-lottery free-sports-bets free-bets-bonus
live-bets-odds bets-odds-bonus cheap-diet-pills cheap-pills-online diet-pills-order pills-order-online cheap-meds-pills cheap-meds-online spam-link-farm spam-farm-network link-farm-network click-farm-network
spam-click-farm ads-track-clicks ads-popup-track track-clicks-popup popup-ads-network ads-click-network adult-cams-live live-cams-adult adult-dating-cams escort-dating-adult payday-loans-cash cheap-payday-loans
fast-cash-loans replica-watches-cheap fake-watches-replica warez-serial-keys serial-keys-crack crack-warez-free torrent-free-warez casino-cash-bonus win-casino-spins online-casino-win live-casino-bets
casino-free-bonus jackpot-cash-win lottery-cash-online lottery-jackpot-odds sports-bets-online bets-free-live bets-bonus-cash cheap-online-meds diet-pills-cheap order-meds-online pills-meds-online
spam-link-network link-spam-click click-spam-network link-farm-spam farm-click-spam ads-track-network track-ads-popup popup-ads-clicks clicks-ads-network ads-popup-clicks live-adult-cams cams-adult-free
adult-escort-live adult-dating-escort cash-loans-fast payday-cash-fast payday-loans-fast replica-watches-online cheap-watches-replica fake-replica-watches serial-keys-warez warez-crack-keys crack-serial-free
torrent-warez-crack free-warez-torrent""".split()
ALLOWED_NAMES = """free-library free-books-online free-museum-day free-city-tours cheap-flights cheap-city-hotels cheap-books win-science-prize win-chess-cup city-win-news cash-museum cash-economy-news casino-history-museum
royal-casino-theatre casino-hotel-history animal-farm farm-market farm-animal-news wind-farm-energy city-track-field race-track-sports track-field-news train-track-map spam-research anti-spam-research
spam-law-news classified-ads-city ads-standards-law city-ads-archive network-research city-network-map sports-live-news live-science sports-odds-research bonus-chapter-books best-bets-science safe-bets-economy
pills-safety-health health-pills-research diet-health-guide diet-research online-health-guide online-library link-archive-map click-chemistry-research popup-city-market popup-books lottery-history
jackpot-history-museum adult-education-city adult-literacy-library dating-fossils-research carbon-dating-science escort-ship-history student-loans-guide loans-economy-law fast-train-map watches-museum
serial-novel-books keys-music-library crack-rock-climbing torrent-river-map order-law-news big-science weather-map recipe-guide wiki-guide school-story blog-travel bonus-tracks-music bonus-lesson-guide link-road-map missing-link-fossils link-bridge-news click-beetle-fossils click-consonants-guide lottery-law-economy
lottery-story-archive jackpot-story-news spins-physics-science odds-ratio-research spam-museum-history network-news-archive cash-crop-farm cash-flow-economy popup-theatre-city watches-history fake-news-research
replica-ship-museum serial-music-archive keys-piano-music crack-climbing-guide meds-history-health order-birds-science escort-fleet-history dating-rocks-science live-birds-map adult-birds-guide fast-food-research
payday-history-law torrent-river-guide casino-film-story clicks-heels-dance spins-dance-music cams-engine-guide warez-word-history""".split()

#: About how many distinct labelled URLs rules are mined from at most (those with the least hashes).
LABELLED_URLS = 200_000
#: What rules must reach. Each example name is several URLs: a rule from examples must hold for two names at least.
LEAST_CONFIDENCE = 0.9
LEAST_SUPPORT = 0.004
EXAMPLE_SUPPORT = 0.0105
#: How many times the least support a rule of one word needs: alone a word tells less than with another.
ONE_WORD = 3


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: words of the host (h:) and of the path (p:), in lower case, numbers as one token."""
    pieces = lambda text, mark: F.transform(F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""), lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)))
    return F.array_distinct(F.concat(pieces(host, "h:"), pieces(path, "p:")))


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), null if none does."""
    out = F.lit(None)
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def example_labels(spark: SparkSession, blocked=BLOCKED_NAMES, allowed=ALLOWED_NAMES) -> DataFrame:
    """Labelled URLs (url, label) made from the fixed names, each in several places and with several tails."""
    named = F.array(*[F.struct(F.lit(w).alias("name"), F.lit(label).alias("label")) for own, label in ((blocked, "block"), (allowed, "allow")) for w in own])
    named = spark.range(1).select(F.explode(named).alias("x")).select("x.*")
    shapes = ["concat('http://', name, '.example.com/en/1')", "concat('https://www.', name, '.example.org/', 'item/22')", "concat('https://m.', name, '.example.net/de/3.html')", "concat('http://blog.', name, '.example.com/es/7')"]
    return named.select(F.explode(F.array(*map(F.expr, shapes))).alias("url"), "label")


def page_labels(rows: DataFrame) -> DataFrame:
    """(url, label) of pages (url): block if a base rule says so, else other. For those who want rules that carry on what the
    base rules do; not used unless given."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return rows.filter(host != "").select("url", F.when(base_rule(host, path)["verdict"] == "block", "block").otherwise("other").alias("label"))


def sampled(labelled: DataFrame, most: int = LABELLED_URLS) -> DataFrame:
    """Distinct rows of labelled (host, path, label): of more than `most`, those whose hashes are in its share of all hashes."""
    labelled = labelled.withColumn("key", F.xxhash64("host", "path"))
    share = min(1.0, most / max(1, labelled.agg(F.approx_count_distinct("key")).first()[0]))
    return labelled.filter(F.col("key") <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True)).select("host", "path", "label").distinct()


def _alike(labelled: DataFrame, least: float) -> DataFrame:
    """(token, number, as_one) of the tokens of labelled (uid, tokens) that at least `least` and not all of them have. as_one
    is the first of the tokens that the very same URLs have: mined for all of them, which changes no rule's figures, and keeps
    a URL of many tokens that always go together from having a power of two of combinations."""
    total = labelled.count()
    own = labelled.select("uid", F.explode("tokens").alias("token"))
    marked = own.groupBy("token").agg(F.count("*").alias("number"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("xor"))
    marked = marked.filter((F.col("number") >= least) & (F.col("number") < total))
    return marked.withColumn("as_one", F.min("token").over(Window.partitionBy("number", "sum", "xor"))).select("token", "number", "as_one")


def mine_rules(labelled: DataFrame, least_support: float = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE, most_tokens: int = 3) -> DataFrame:
    """(rule, tokens, listed, confidence, support) from labelled URLs (host, path, label); rules are for the label block.

    listed is the rarest of a rule's tokens. A rule of one token needs ONE_WORD times the least support. Where several tokens have the very same URLs, a rule names the first of them. Of
    more than LABELLED_URLS distinct URLs a share is mined. Rows with a null in any of the three are left out. No labels, or
    none of block, give no rules. Rules of equal figures are all kept; url_filter() then names the last by its tokens.
    """
    labelled = sampled(labelled.filter("host is not null and path is not null and label is not null"))
    labelled = cut(labelled.select(tokens_of(F.col("host"), F.col("path")).alias("tokens"), "label")).withColumn("uid", F.monotonically_increasing_id())
    counts = cut(_alike(labelled, least_support * labelled.count()))
    own = labelled.select("uid", "label", F.explode("tokens").alias("token")).join(small_or_shuffled(counts.select("token", "as_one")), "token")
    items = own.groupBy("uid", "label").agg(F.collect_set("as_one").alias("items")).select(F.array_append("items", F.concat(F.lit("label="), F.col("label"))).alias("items"))
    bare = labelled.join(own.select("uid").distinct(), "uid", "left_anti").select(F.array(F.concat(F.lit("label="), F.col("label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(items.unionByName(bare))
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit("label=block")))
    enough = (F.size("tokens") > 1) | (F.col("support") >= ONE_WORD * least_support)
    rules = rules.filter((F.size("antecedent") <= most_tokens) & (F.col("lift") > 1) & ~F.exists("antecedent", lambda t: t.startswith("label=")))
    # first what a shorter rule implies goes, so that no word is added only to be two
    rules = _pruned(cut(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))).filter(enough)
    rarest = rules.select("tokens", F.explode("tokens").alias("token")).join(small_or_shuffled(counts.select("token", "number")), "token")
    rarest = rarest.groupBy("tokens").agg(F.min_by("token", F.struct("number", "token")).alias("listed"))
    return rules.join(rarest, "tokens").select(F.array_join("tokens", " ").alias("rule"), "tokens", "listed", "confidence", "support")


def _pruned(rules: DataFrame) -> DataFrame:
    """Without rules that hold all tokens of another one: where they fit, that one does. Met by a shared token, not in pairs of all."""
    other = rules.select(F.col("tokens").alias("less"), F.element_at("tokens", 1).alias("token"))
    listed = rules.select("tokens", F.explode("tokens").alias("token"))
    implied = listed.join(other, "token").filter((F.size("less") < F.size("tokens")) & (F.size(F.array_except("less", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(implied, "tokens", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, learned): the URLs (uid, tokens) that a rule fits, and the strongest such rule: by confidence, then support, then
    name. Rules are broadcast after their number has been counted."""
    rules = rules.select("rule", F.col("tokens").alias("needed"), "confidence", "support", F.col("listed").alias("token"))
    own = urls.select("uid", "tokens", F.explode("tokens").alias("token"))
    met = own.join(small_or_shuffled(rules), "token").filter(F.size(F.array_except("needed", "tokens")) == 0)
    return met.groupBy("uid").agg(F.max(F.struct("confidence", "support", "rule"))["rule"].alias("learned"))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, url_col: str = "url", base_rules=BASE_RULES, least_support: float | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, learned) for each row of pages (page_id and a url).

    host and path are empty for a null url or one without "://". rule is the longest base rule that fits, else null;
    without one, verdict is block if a learned rule fits (learned names the strongest), else allow. Rules are learned from
    labelled (url, label: block or another), or without it from examples. Repeated rows come back once each; other columns,
    of whatever name, are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    url = F.col(url_col)
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = cut(rows.withColumn("base", base_rule(F.col("host"), F.col("path"), base_rules))).withColumn("uid", F.monotonically_increasing_id())
    least_support = least_support or (EXAMPLE_SUPPORT if labelled is None else LEAST_SUPPORT)
    labelled = (example_labels(spark) if labelled is None else labelled).filter("url is not null")
    rules = mine_rules(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label"), least_support)
    # what a base rule judges, or has no host, meets no learned rule
    is_open = F.col("base").isNull() & (F.col("host") != "")
    open_rows = rows.filter(is_open)
    found = match_rules(open_rows.select("uid", tokens_of(F.col("host"), F.col("path")).alias("tokens")), cut(rules))
    decided = rows.filter(~is_open).withColumn("learned", F.lit(None).cast("string"))
    out = open_rows.join(found, "uid", "left").unionByName(decided)
    verdict = F.coalesce("base.verdict", F.when(F.col("learned").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("base.rule").alias("rule"), verdict.alias("verdict"), "learned")
