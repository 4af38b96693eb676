import random
import re

import pytest

from sightline.llm import jaccard, tables
from sightline.llm.jaccard import near_duplicates


def brute(rows, k=5):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted((str(key), len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("common, block, shingles", [(1000, 1000, 1 << 23), (2, 3, 1 << 23), (2, 3, 1000)])
def test_against_brute_force(spark, monkeypatch, common, block, shingles):
    """Also with keys, lists and sets so common that they are dealt to several tasks."""
    monkeypatch.setattr(tables, "COMMON_ROWS", common)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    # with 1000 shingles only the shorter common sets are broadcast
    monkeypatch.setattr(jaccard, "COMMON_PAIRS", common)
    monkeypatch.setattr(jaccard, "COMMON_SHINGLES", shingles)
    r = random.Random(3)
    word = lambda n: ["w%d" % r.randrange(400) for _ in range(n)]
    passage = word(60)
    rows = []
    for g in range(12):
        base = word(r.choice([7, 30, 80, 200]))
        for _ in range(r.choice([1, 2, 6, 20])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 8])):
                text[r.randrange(len(text))] = word(1)[0]
            rows.append((len(rows) * 3 % 1009, " ".join(text)))
    for u in range(40):
        rows.append((2000 + u, " ".join(passage + word(8 + u % 14))))
    check(spark, rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a\tB"), (5, "a b"), (6, "a b c"), (None, "x y z"), (7, "x y z"), (8, "b a"), (9, "é É"), (10, "É é")]
    rows += [(20 + i, "one two three four five six" if i % 2 else "one two three four five six seven") for i in range(6)]
    check(spark, rows)


def test_empty_and_extra_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, node long, token long")
    assert [tuple(x) for x in near_duplicates(df).collect()] == [(1, 1, 1)]
