import random
import re
from collections import Counter, defaultdict

from sightline.llm.divergence import source_divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = [s for x, s in groups if x == lang]
        number = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        total, v = sum(number.values()), len(kept)
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (number[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (total + 2 * v) for t in kept}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(apart(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1)}
    return out


def test_all_pairs_and_terms(spark):
    r = random.Random(3)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)] + ["É", "été", "日本", "naïve", "WaB"]
    rows = [(r.choice(["en", "fr", "", None]), r.choice([f"s{k}" for k in range(23)] + [None]), " ".join(r.choice(words[: r.choice([5, 40, 205])]) for _ in range(r.randrange(40)))) for _ in range(600)]
    rows += [("en", "hot", "waa wab hot")] * 300 + [("xx", "only", "a a"), ("yy", "a", "rare"), ("yy", "b", None), ("en", "wordless", "1 2 3"), ("en", "quiet", None), ("en", "long", "waa wqq " * 30_000)]
    df = spark.createDataFrame([(i, t, a, b, 1) for i, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term int")
    want = brute(rows, 4, 3)
    for tiles in ({}, {"block": 2, "chunk": 16, "span": 2}, {"block": 1, "chunk": 1, "span": 1000}):
        got = [tuple(x) for x in source_divergence(df, 4, 3, **tiles).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_rows_and_no_words(spark):
    schema = "lang string, source string, text string"
    assert source_divergence(spark.createDataFrame([], schema)).collect() == []
    silent = spark.createDataFrame([("a", "x", ""), ("a", "y", "few words"), ("a", None, None), ("b", "z", "w " * 50)], schema)
    got = sorted(tuple(x) for x in source_divergence(silent).collect())
    assert got == [("a", "", "pair", "x", 0, 1), ("a", "", "pair", "y", 0, 2), ("a", "x", "pair", "", 0, 1), ("a", "x", "pair", "y", 0, 2), ("a", "y", "pair", "", 0, 1), ("a", "y", "pair", "x", 0, 2)]
