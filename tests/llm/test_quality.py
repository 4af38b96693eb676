import random
import re
from collections import Counter

import numpy as np

from sightline.llm.quality import Rule, learn_list, quality, text_statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_statistics_against_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t ", "a", "é é é é", "x\n\nx\n x\nx", "a b  c", "\U0001f600 # <b>", "a b c\na b c"]
    for _ in range(80):
        texts.append("".join(r.choice(["a", "b", " ", " ", "\n", "é", "#", "|", "c d e ", "\r", "\t"]) for _ in range(r.randrange(120))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in text_statistics(docs, ["doc_id"]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_learned_list_finds_planted_rules():
    r = np.random.default_rng(0)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    bad = (x["a"] > 0.9) | ((x["b"] > 0.8) & (x["c"] < 0.3))
    rules = learn_list(x, bad)
    caught = np.any([rule.covers(x) for rule in rules], axis=0)
    assert caught[bad].mean() > 0.85 and caught[~bad].mean() < 0.02
    assert learn_list(x, r.random(3000) < 0.1) == []
    assert str(Rule((("a", False, 0.5),))) == "a >= 0.5"


def test_verdicts(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(300):
        junk = i % 3 == 0
        docs.append((i, " ".join(word() + ("###" if junk else "") for _ in range(80)), "x"))
        if i < 240:
            labels.append((i, int(not junk), 0))
    docs += [(900, None, "x"), (901, "", "x"), (902, "a b", "x"), (903, "one two three " * 30, "x")]
    labels += [(None, 1, 0), (5, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    got = {x.doc_id: x for x in quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(docs)
    for i in range(300):
        assert got[i].kept == (i % 3 != 0) and not got[i].base_failed
    assert all(got[i].base_failed and not got[i].kept for i in (900, 901, 902, 903))
    none = quality(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(x.kept != x.base_failed for x in none)
    assert quality(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
