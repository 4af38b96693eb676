"""Quality rules: text statistics and a learned decision list over them.

Sequential covering: a rule (a conjunction of thresholds) is grown on two thirds of the labelled rows by the gain in
information about the rejected ones, pruned on the other third, and kept if enough of what it covers is rejected; what
it covers is set aside and the next rule is grown. The list becomes one ordered Spark CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, Words, mix, ngrams, text_chunks
from .tables import in_small_batches

_U = np.uint64
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Most labelled rows that the list is learned from: those with the least hashes of their ids.
LABELLED_ROWS = 20_000
#: What the rules look at, as SQL over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines": "cast(n_dup_lines as double)",
}


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = Words(data, offsets, NOT_SPACE, lower=False)
    hashes, first = words.hashes(), words.first
    doc = np.repeat(np.arange(len(first) - 1), words.counts)
    chars = _per_text(words.inside & ((data & 0xC0) != 0x80), offsets)

    grams = ngrams(hashes, 3)
    own = np.flatnonzero(doc[2:] == doc[:-2])
    again = own[_repeats(mix(grams[own] + mix(doc[own].astype(_U))))]
    repeated = np.zeros(len(hashes), bool)
    for j in range(3):
        repeated[again + j] = True

    # lines as words of a text whose only gaps are line ends
    is_line = np.ones(256, bool)
    is_line[10] = False
    lines = Words(data, offsets, is_line, lower=False)
    worded = np.concatenate(([0], np.cumsum(words.inside)))
    full = np.flatnonzero(worded[lines.ends] > worded[lines.starts])
    line_doc = np.repeat(np.arange(len(first) - 1), lines.counts)[full]
    key = mix(lines.hashes()[full] + mix(line_doc.astype(_U)))
    order = np.lexsort((np.arange(len(key)), key))
    later = np.zeros(len(key), bool)
    later[order[1:][key[order][1:] == key[order][:-1]]] = True
    dup_lines = np.bincount(line_doc[later], minlength=len(first) - 1)
    return [words.counts, chars, _per_text(_SYMBOL[data], offsets), dup_lines, _per_text(repeated, first)]


def _measure(batches):
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"]
        text = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("row"), "text")
        for a, b, data, offsets in text_chunks(text):
            stats = [pa.array(x.astype(np.int64)) for x in _statistics(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in rest] + stats, names=rest + _STATS)


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, which must not be named like a statistic, and n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words of each row's whole text (null: none). Words are runs of anything but ASCII white space."""
    return _measured(in_small_batches(docs).select(*keep, "text"))


def rows_with_statistics(docs: DataFrame) -> DataFrame:
    """(row, n_words, ...): each row of docs whole, as a struct, and its statistics, whatever its columns are called."""
    return _measured(in_small_batches(docs).select(F.struct(*docs.columns).alias("row")))


def _measured(chosen: DataFrame) -> DataFrame:
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text"] + [f"{s} long" for s in _STATS])
    return chosen.mapInArrow(_measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects rows for which all conditions (feature, is it an upper bound, bound) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, upper, bound in self.conditions:
            out &= (x[name] <= bound) if upper else (x[name] >= bound)
        return out

    def expression(self) -> Column:
        out = F.lit(True)
        for name, upper, bound in self.conditions:
            value = F.expr(FEATURES[name])
            out = out & ((value <= bound) if upper else (value >= bound))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if u else '>='} {b:.6g}" for n, u, b in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule, inside = Rule(()), np.ones(len(bad), bool)
    while len(rule.conditions) < most and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (0.0, None, None)
        for name, values in x.items():
            own = values[inside]
            for bound in np.unique(np.quantile(own, np.linspace(0, 1, 65), method="nearest")):
                for upper in (False, True):
                    new = (own <= bound) if upper else (own >= bound)
                    p, n = bad[inside][new].sum(), new.sum()
                    if p and n < n0:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, upper, float(bound)), None)
        if best[1] is None:
            break
        rule = Rule((*rule.conditions, best[1]))
        inside = rule.covers(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        inside = r.covers(x)
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    options = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
    return max(options, key=worth) if options else rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.95, least_rows: int = 5, most_conditions: int = 4, most_rules: int = 12) -> list[Rule]:
    """Ordered rules for the rows with bad set; x has one array for each feature. Rows 2, 5, 8, ... are for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and bad[left].sum() >= least_rows:
        grow, prune = left.copy(), left.copy()
        grow[2::3] = False
        prune[:] &= ~grow
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        if not rule.conditions:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        inside = rule.covers(x) & left
        if inside.sum() < least_rows or bad[inside].mean() < least_precision:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> list[Rule]:
    """The decision list from labels (doc_id, quality: 0 is bad), learned on at most labelled_rows of them: those with the
    least hashes of their ids, and of an id's texts the one with the least statistics.

    Documents that the base rule fails anyway are left out. Null labels and ids are left out; without rows of both kinds
    the list is empty and rejects nothing.
    """
    order = F.xxhash64("doc_id")
    sample = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(order, "doc_id", "quality").limit(labelled_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    stats = text_statistics(rows, ["doc_id", "quality"]).filter(~base_failed())
    seen = stats.select("doc_id", "quality", F.struct(*[F.expr(e).alias(n) for n, e in FEATURES.items()]).alias("x"))
    # at most one row for each row of the sample
    seen = seen.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("doc_id", "quality", "x.*").toPandas()
    seen = seen.assign(rank=mix(seen["doc_id"].to_numpy(np.int64).view(_U)) if len(seen) else []).sort_values(["rank", "doc_id", "quality"])
    bad = seen["quality"].to_numpy() == 0
    if not len(seen) or bad.all() or not bad.any():
        return []
    return learn_list({n: seen[n].to_numpy(np.float64) for n in FEATURES}, bad)


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that rejects a row of statistics, 0 if none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.expression(), F.lit(k)).otherwise(out)
    return out


def quality(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) for each row of docs.

    kept is false if base_failed, else the learned list's verdict; rule is the number of the rule that rejects, 0 for
    none. Null, empty and blank texts have no words and fail the base rule. Repeated rows come back once each; other
    columns are ignored; an empty table gives no rows.
    """
    rules = fit(docs, labels, labelled_rows)
    stats = text_statistics(docs, ["doc_id"])
    rule = verdict(rules)
    return stats.select("doc_id", *_STATS, base_failed().alias("base_failed"), (~base_failed() & (rule == 0)).alias("kept"), rule.alias("rule"))
