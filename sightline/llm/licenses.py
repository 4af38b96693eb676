"""Licence scan by a positional index of rare words, in DataFrame expressions alone.

Templates are licence notices and phrases. Inverse document frequencies of their words are counted over all documents.
A file looks up the highest-IDF words of each template: every place of such a word says where the template would begin,
and the places on which the rare words agree are candidates. A phrase template must then stand there word for word; a
notice must hold its mandatory key phrase there, and its score is the share of its IDF weight that stands in place.

Texts are read once. What is kept of each is which template words it holds and, if they make up any key phrase, the
number of the template word at each place; frequencies, look-ups and scores come from that small table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ascii_lower, cut


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: (first word, end) of the part that must stand word for word.
    key: tuple[int, int]
    base: bool = False


def template(label: str, notice: str, key: str | None = None, base: bool = False) -> Template:
    words = tuple(notice.split())
    wanted = tuple((key or notice).split())
    at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
    return Template(label, words, (at, at + len(wanted)), base)


# Phrases with the labels asked for, then well-known notices in lower case without punctuation.
TEMPLATES = (
    template("cc-by", "cc by", base=True),
    template("gpl", "general public license", base=True),
    template("reserved", "all rights reserved", base=True),
    template("agpl-3.0", "gnu affero general public license", "affero general public license"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("artistic-2.0", "the artistic license 2 0", "artistic license 2 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("bsl-1.0", "boost software license version 1 0", "boost software license"),
    template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    template("cc0-1.0", "cc0 1 0 universal", "cc0 1 0"),
    template("epl-2.0", "eclipse public license 2 0", "eclipse public license"),
    template("gpl-2.0", "under the terms of the gnu general public license version 2", "general public license version 2"),
    template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    template("mit", "released under the mit license", "mit license"),
    template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("proprietary", "proprietary and confidential", "proprietary and confidential"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)

#: Rare words that a notice is looked up by; two of them must agree on its place.
RARE = 3
#: Least score of a notice.
LEAST_SCORE = 0.6
#: Words as what they hold and not as what they don't: Java matches such a class some twenty times as fast.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def positions(docs: DataFrame, templates: tuple[Template, ...], vocabulary: list[str]) -> DataFrame:
    """(doc_id, n_words, present, ids), written once: the numbers (from 1) of the vocabulary words in each text, and the
    number at each place (0: another word) of texts that hold all words of a key phrase, else null."""
    known = F.array(*map(F.lit, vocabulary))
    number = lambda w: F.array_position(known, w).cast("short")
    words = docs.select("doc_id", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), 0).alias("words"))
    words = words.select("doc_id", "words", F.array_intersect("words", known).alias("held"))
    may_match = F.lit(False)
    for key in sorted({tuple(sorted(set(t.words[slice(*t.key)]), key=lambda w: (-len(w), w))) for t in templates}):
        whole = F.lit(True)
        for w in key:
            whole = whole & F.array_contains("held", w)
        may_match = may_match | whole
    ids = F.when(may_match, F.transform("words", number))
    return cut(words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform("held", number).alias("present"), ids.alias("ids")))


def inverse_frequencies(seen: DataFrame, vocabulary: list[str]) -> list[float]:
    """IDF of each vocabulary word over all texts; what comes to the driver is one count a word."""
    held = seen.select(F.explode(F.array_append("present", F.lit(0).cast("short"))).alias("id"))
    counts = {r.id: r.number for r in held.groupBy("id").agg(F.count("*").alias("number")).collect()}
    return [math.log((counts.get(0, 0) + 1) / (counts.get(k, 0) + 1)) + 1 for k in range(1, len(vocabulary) + 1)]


def _rare(t: Template, idf: dict[str, float]) -> list[int]:
    """Places in the template of the words that it is looked up by, each word once."""
    first = {w: i for i, w in reversed(list(enumerate(t.words)))}
    order = sorted(first.items(), key=lambda x: (-idf[x[0]], x[0]))
    # a phrase stands whole or not at all, so its rarest word alone finds every place
    return [i for _, i in order[: 1 if t.base else RARE]]


def _starts(hits: Column, own: list[tuple[int, int]]) -> Column:
    """Where the template would begin by its rare words (number, place in the template)."""
    def begins(k: int, i: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["id"] == k), lambda h: h["i"] - F.lit(i))

    lists = [begins(k, i) for k, i in own]
    if len(lists) == 1:
        return lists[0]
    pairs = [F.array_intersect(a, b) for k, a in enumerate(lists) for b in lists[k + 1 :]]
    return F.array_distinct(F.concat(*pairs))


def _matches(ids: Column, hits: Column, t: Template, rare: list[int], number: dict[str, int], idf: dict[str, float]) -> Column:
    """array<struct<label,base,start,length,score>> of the places where the template stands."""
    a, b = t.key
    short = lambda words: F.array(*[F.lit(number[w]).cast("short") for w in words])
    key = short(t.words[a:b])
    # the key phrase lies inside the text; what comes before it in the notice may be cut off by the text's start
    stands = lambda s: (s + a >= 0) & (F.slice(ids, F.greatest(s + a, F.lit(0)) + 1, b - a) == key)
    found = F.filter(_starts(hits, [(number[t.words[i]], i) for i in rare]), stands)
    total = sum(idf[w] for w in t.words)
    weighed = F.array(*[F.struct(F.lit(number[w]).cast("short").alias("id"), F.lit(idf[w] / total).alias("x")) for w in t.words])

    def score(s: Column) -> Column:
        if (a, b) == (0, len(t.words)):
            return F.lit(1.0)
        before = F.array_repeat(F.lit(None).cast("short"), F.greatest(-s, F.lit(0)))
        inside = F.slice(ids, F.greatest(s, F.lit(0)) + 1, F.lit(len(t.words)) + F.least(s, F.lit(0)))
        own = F.zip_with(F.concat(before, inside), weighed, lambda w, y: F.when(w == y["id"], y["x"]).otherwise(F.lit(0.0)))
        return F.round(F.aggregate(own, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0))), 6)

    out = F.transform(found, lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.greatest(s, F.lit(0)).alias("start"), (F.lit(len(t.words)) + F.least(s, F.lit(0))).alias("length"), score(s).alias("score")))
    return F.filter(out, lambda m: m["score"] >= LEAST_SCORE)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, matches) for each row of docs; matches are array<struct<label, base, start, length, score>> by
    start and label, start counting words from 0. A notice whose first words are cut off by the text's start begins at 0.

    Words are runs of ASCII letters and digits and anything beyond ASCII, A-Z in lower case. Null and empty texts have no
    words and no matches; repeated rows come back once each; other columns are ignored; an empty table gives no rows.
    """
    # short words are the common ones and so are found first
    vocabulary = sorted({w for t in templates for w in t.words}, key=lambda w: (len(w), w))
    number = {w: k for k, w in enumerate(vocabulary, 1)}
    seen = positions(docs, templates, vocabulary)
    idf = dict(zip(vocabulary, inverse_frequencies(seen, vocabulary)))
    rare = [_rare(t, idf) for t in templates]
    anchors = F.array(*[F.lit(k).cast("short") for k in sorted({number[t.words[i]] for t, places in zip(templates, rare) for i in places})])
    hits = F.filter(F.transform("ids", lambda x, i: F.struct(x.alias("id"), i.alias("i"))), lambda h: F.array_contains(anchors, h["id"]))
    looked_up = seen.select("doc_id", "n_words", "ids", hits.alias("hits"))
    matches = F.concat(*[_matches(F.col("ids"), F.col("hits"), t, r, number, idf) for t, r in zip(templates, rare)])
    none = F.expr("cast(array() as array<struct<label:string,base:boolean,start:int,length:int,score:double>>)")
    ordered = F.array_sort(matches, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["label"] < y["label"], -1).when(x["label"] > y["label"], 1).otherwise(0))
    return looked_up.select("doc_id", "n_words", F.when(F.col("ids").isNotNull(), ordered).otherwise(none).alias("matches"))


def license_digest(scanned: DataFrame) -> DataFrame:
    """One row of counts and labels for each row of license_scan()."""
    base = F.filter("matches", lambda m: m["base"])
    places = F.transform(base, lambda m: m["start"].cast("long"))
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
