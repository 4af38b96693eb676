import random
import re

import pytest

from sightline.llm import decontaminate
from sightline.llm.decontaminate import contamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = []
    for key, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, body in items:
            own = words_of(body)
            length = min(size, len(own))
            if not length or item is None:
                continue
            windows = {tuple(own[i : i + length]) for i in range(len(own) - length + 1)}
            for i in range(len(words) - length + 1):
                if tuple(words[i : i + length]) in windows:
                    hit.update(range(i, i + length))
                    found.add(str(item))
        out.append((key, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_windows, rows_a_task", [(100_000, 1), (40, 500_000), (0, 3)])
def test_against_brute_force(spark, monkeypatch, broadcast_windows, rows_a_task):
    monkeypatch.setattr(decontaminate, "ROWS_A_TASK", rows_a_task)
    r = random.Random(5)
    word = lambda n: " ".join(r.choice(["Ab", "cd", "é", "x9", "zz", "Q", "m%d" % r.randrange(30)]) for _ in range(n))
    items = [(i, word(r.choice([1, 2, 3, 9, 10, 11, 25, 40]))) for i in range(12)] + [(50, None), (51, ""), (52, "--"), (None, word(12)), (60, word(20))] * 2
    docs = []
    for d in range(60):
        parts = [word(r.randrange(30))]
        for _ in range(r.randrange(3)):
            own = words_of(r.choice(items[:12])[1])
            a = r.randrange(len(own))
            parts += [", ".join(own[a : a + r.choice([3, 10, 40])]).upper(), word(r.randrange(6))]
        docs.append((d, " - ".join(parts)))
    docs += [(90, None), (91, ""), (92, "..."), (93, docs[3][1]), (3, docs[3][1]), (None, docs[4][1])]
    docs.append(docs[7])
    own = [(*d, 1, "x", "y") for d in docs]
    got = contamination(spark.createDataFrame(own, "doc_id long, text string, same int, token string, h_doc string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=broadcast_windows)
    rows = got.collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in rows), key=str) == brute(docs, items)
    assert all(x.n_hit == sum(s.end - s.start for s in x.spans) for x in rows)


@pytest.mark.parametrize("broadcast_windows", [100, 0])
def test_very_long_text(spark, broadcast_windows):
    """An item many times over in one text of a million words, with repeated rows and ties in frequency."""
    item = " ".join(f"w{i}" for i in range(30))
    text = " ".join([item, "x y z"] * 30_000)
    docs = spark.createDataFrame([(1, text), (1, text), (2, "w1 w2 w3")], "doc_id long, text string")
    got = contamination(docs, spark.createDataFrame([(7, item), (8, item)], "item_id long, text string"), broadcast_windows=broadcast_windows).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, len(x.spans), x["items"]) for x in got) == [(1, 990_000, 900_000, 30_000, ["7", "8"])] * 2 + [(2, 3, 0, 0, [])]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(x.n_words, x.n_hit) for x in contamination(docs, items).collect()] == [(2, 0)]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
