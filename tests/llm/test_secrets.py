import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from sightline.llm.secrets import redact, secret_digest, secret_scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    text = text or ""
    assign = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    access = [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    hexes = [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    told = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(assign + access + hexes))
    return len(assign), len(access), len(hexes), hashlib.sha256(told.encode()).hexdigest(), told


def scan(df):
    return secret_scan(df, F.col("source"), F.concat_ws("/", "source", "lang"))


def test_base_against_brute_force(spark):
    r = random.Random(2)
    parts = ["token = ", "PassWord:'", "api_key=", "APIKEY : \"", "secret", "=", " ", "é", "\U0001f600", "abcdef12", "0123456789abcdef" * 2, "0123456789abcdef", "AKIA", "ABCDEFGH1234", "x", "-", "\n", "token: secret = longvalue9", "passwd=short"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randrange(14))), "s%d" % (i % 7), "en") for i in range(300)]
    docs += [(900, None, None, None), (901, "", "s1", None), docs[5], (5, docs[6][1], "s2", "en"), (None, "token=abcdefghij", "s3", "en"), (902, "token=abcdefgh " * 2000, "s", "de")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, lang string, owner string")
    got = secret_digest(scan(df)).collect()
    want = [(d[0], *brute(d[1])[:4]) for d in docs]
    assert sorted(((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in got), key=str) == sorted(want, key=str)
    told = {(x.doc_id, x.base_sha256): x.spans for x in got}
    for d in docs:
        base = brute(d[1])
        assert set(filter(None, base[4].split(","))) <= set(told[d[0], base[3]].split(","))


def test_ownership_tells_examples_from_live(spark):
    live, example = "ghp_" + "A1b2" * 6, "ghp_" + "EXAM" * 6
    docs = [(i, f"see {example} here", f"s{i % 6}", "en") for i in range(60)] + [(100, f"my {live}", "s1", "en"), (101, f"again {live}", "s1", "de"), (102, "token=" + example, "s9", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = {x.doc_id: x for x in secret_digest(scan(df)).collect()}
    assert got[100].spans == f"github:3:{3 + len(live)}" and got[101].n_live == 1
    assert got[0].spans == "" and got[102].spans.startswith("assign:0:") and got[102].n_example == 1


def test_repositories_tell_shared_examples_from_an_owners_key(spark):
    own, shared, few = ("ghp_" + x * 6 for x in ("Own1", "Shr2", "Few3"))
    # owners agree (two each); repositories differ: six hold one value, two the other. One owner's key is live in ten.
    docs = [(i, f"see {shared}", f"s{i % 2}", f"l{i % 6}") for i in range(12)] + [(100 + i, few, f"s{i % 2}", "en") for i in range(12)] + [(200 + i, own, "s9", f"l{i}") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    rows = {x.doc_id: x for x in scan(df).collect()}
    assert rows[0].spans == [] and [(s.live, s.owners, s.repositories) for s in rows[100].spans] == [(True, 2, 2)]
    assert [(s.live, s.owners, s.repositories) for s in rows[200].spans] == [(True, 1, 10)]


def test_common_values_meet_their_counts_by_broadcast(spark, monkeypatch):
    from sightline.llm import tables

    text = "token=aaaaaaaa token=bbbbbbbb"
    df = spark.createDataFrame([(i, text if i % 2 else "secret=aaaaaaaa", f"s{i % 9}", "en") for i in range(90)], "doc_id long, text string, source string, lang string")
    want = sorted(secret_digest(scan(df)).collect())
    monkeypatch.setattr(tables, "COMMON_ROWS", 50)
    assert sorted(secret_digest(scan(df)).collect()) == want


def test_many_matches_in_linear_time(spark):
    n, one = 200_000, "token=abcdefgh é "
    df = spark.createDataFrame([(1, one * n, "s", "en"), (2, "x", "s", "en")], "doc_id long, text string, source string, lang string")
    began = time.time()
    got = {x.doc_id: x for x in secret_digest(scan(df)).collect()}
    assert got[1].n_assign == n and got[1].spans.endswith(f"assign:{17 * n - 17}:{17 * n - 3}") and got[2].n_assign == 0
    assert time.time() - began < 20
    began = time.time()
    assert {x.doc_id: x.text for x in redact(df, scan(df)).collect()}[1] == "[SECRET] é " * n
    assert time.time() - began < 30


def test_redaction_of_overlapping_spans_in_clashing_columns(spark):
    r = random.Random(4)
    parts = ["token = ", "secret=", "abcdef12", "0123456789abcdef" * 2, "AKIA", "ABCDEFGH1234", " ", "é", "\U0001f600", "\n", "x" * 300]
    docs = [(i if i % 9 else None, "".join(r.choice(parts) for _ in range(r.randrange(20))), f"s{i}", "en", 1, 2, 3, 4) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, r_doc int, r_same int, _r_ranges int, same int")
    want = []
    for d in docs:
        spans = sorted((int(a), int(b)) for a, b in (x.split(":")[1:] for x in filter(None, brute(d[1])[4].split(","))))
        out, at = "", 0
        for a, b in spans:
            out, at = (out + d[1][at:a] + "[SECRET]" if a >= at else out), max(at, b)
        want.append((d[0], out + d[1][at:], *d[2:]))
    got = redact(df, scan(df))
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_redaction(spark):
    secret = "0123456789abcdef" * 2 + "01"
    docs = [(1, f"é token = \"{secret}\" end", "s", "en", 7), (2, "plain api text", "s", "en", 14), (3, None, "s", "en", None), (4, f"{secret} {secret}", "s", "en", 9), (4, f"{secret} {secret}", "s", "en", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    got = sorted((x.doc_id, x.text, x.n_chars) for x in redact(df, scan(df)).collect())
    assert got == [(1, 'é [SECRET]" end', 15), (2, "plain api text", 14), (3, None, None), (4, "[SECRET] [SECRET]", 17), (4, "[SECRET] [SECRET]", 17)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert secret_digest(scan(df)).collect() == []
