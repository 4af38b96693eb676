import random
import re
import time

from sightline.llm.licenses import TEMPLATES, license_digest, license_scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    words = words_of(text)
    found = [(i, label) for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")) for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_against_brute_force(spark):
    r = random.Random(7)
    parts = ["cc", "by", "CC-BY", "general", "public", "License", "all", "rights", "reserved", "All Rights Reserved.", "GNU General Public License, version 3", "é", "x1", "Released under the MIT License.", "\U0001f600", "cc by cc by"]
    docs = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(30)))) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "--"), (903, "cc  by"), (904, "accc by"), (903, "cc by"), (None, "cc by")]
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, words int, hits string")
    got = license_digest(license_scan(df)).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got), key=str) == sorted(((i, *brute(t)) for i, t in docs), key=str)
    assert all(0 <= x.score <= 1 and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) for x in got)


def test_notices(spark):
    mit = next(t for t in TEMPLATES if t.label == "mit" and len(t.words) > 10)
    bsd = next(t for t in TEMPLATES if t.label == "bsd")
    texts = {
        1: "Header. " + " ".join(mit.words).title() + ". End",
        2: "Licensed under the Apache License, Version 2.0.",
        3: "Licensed under CC BY-NC 4.0.",
        4: " ".join(w if i != 8 else "modified" for i, w in enumerate(bsd.words)),  # one word outside the key differs
        5: " ".join(w if i != 1 else "or" for i, w in enumerate(bsd.words)),  # one word of the key differs
        6: "the apache people met version 2 of a license",
        7: "This work is licensed under the GNU General Public License, version 3.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x for x in license_digest(license_scan(df)).collect()}
    assert [got[i].labels for i in sorted(got)] == ["mit", "apache-2.0", "cc-by,cc-by-nc", "bsd", "", "", "gpl,gpl-3.0"]
    assert got[1].score == 1 and 0.6 < got[4].score < 1 and got[6].score == 0
    spans = {m.label: (m.start, m.length) for m in license_scan(df).filter("doc_id = 1").first().matches}
    assert spans == {"mit": (1, len(mit.words))}


def test_key_phrase_at_word_0(spark):
    """A notice that lacks what comes before its key phrase: the score is the weight of what stands, as where words lead the text."""
    cut = [t for t in TEMPLATES if not t.base and t.key[0] > 0]
    texts = [" ".join(t.words[t.key[0] :]) for t in cut]
    docs = [(2 * i + k, ("" if k else "zz " * 40) + text) for i, text in enumerate(texts) for k in (0, 1)]
    # the words before the key phrases are common ones
    docs += [(1000 + i, " ".join(sorted({w for t in cut for w in t.words[: t.key[0]]}))) for i in range(300)]
    scanned = license_scan(spark.createDataFrame(docs, "doc_id long, text string")).filter("doc_id < 1000").collect()
    found = {(x.doc_id, m.label): m for x in scanned for m in x.matches}
    led, first = ({(d // 2, label): m for (d, label), m in found.items() if d % 2 == k} for k in (0, 1))
    assert {k: m.score for k, m in first.items()} == {k: m.score for k, m in led.items()}
    assert {i for i, label in first if cut[i].label == label} == set(range(len(cut)))
    for (i, label), m in first.items():
        if label == cut[i].label:
            assert (m.start, m.length) == (0, len(texts[i].split()))


def test_very_long_text(spark):
    """400,000 words, a phrase at every second one; a word of three million letters; texts of rare words alone."""
    docs = [(1, "CC-by " * 200_000 + "all rights reserved"), (2, "x" * 3_000_000 + " general public license"), (3, "license " * 100_000), (1, "CC-by " * 200_000 + "all rights reserved")]
    began = time.time()
    got = license_digest(license_scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    want = [(i, *brute(t)) for i, t in docs]
    assert sorted((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got) == sorted(want)
    assert time.time() - began < 60


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
