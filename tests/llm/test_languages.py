import math
import zlib

import numpy as np

from sightline.llm.languages import GRAMS, fit, language_id, letter_classes, present, predict

WORDS = {"aa": "tha wer ing onde strai".split(), "bb": "quel ouai ère paré leux".split(), "cc": "żółć źdźbło ксю щука".split()}


def made(n, seed):
    r = np.random.default_rng(seed)
    return [(int(i), " ".join(r.choice(WORDS[lang]) for _ in range(r.integers(1, 30))), lang) for i, lang in zip(range(n), r.choice(list(WORDS), n))]


def grams_of(text):
    """Runs of characters that are no letters are one boundary; there is one on either side."""
    out = [""]
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out[-1]:
            out.append("")
    if out[-1]:
        out.append("")
    return {tuple(out[i : i + n]) for n in (1, 2, 3) for i in range(len(out) - n + 1)}


def test_presence():
    letters = [ord(c) for c in "abcdeéç"]
    flags = np.zeros(GRAMS, bool)
    for text in ("", "a", "Abc  De!! é", "...", "a1b", "aaaa", "É ç" * 50):
        present(text, letter_classes(letters), flags)
        assert flags.sum() == len(grams_of(text)), text


def test_scores_are_kernel_ridge_regression(spark):
    rows = [(i, t, lang) for i, t, lang in made(60, 1) if zlib.crc32(str(i).encode()) % 4 != 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, rows_a_language=1_000_000, landmarks=1000, ridge=1e-2)
    sets = [grams_of(t) for _, t, _ in rows]
    kernel = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y))
    k = np.array([[kernel(x, y) for y in sets] for x in sets])
    y = np.array([[lang == c for c in model.langs] for _, _, lang in rows], float)
    coefficients = np.linalg.lstsq(k @ k + 1e-2 * len(rows) * k, k @ y, rcond=1e-12)[0]
    others = [t for _, t, _ in made(40, 2)] + ["tha tha", "zzz"]
    want = np.array([[kernel(grams_of(t), s) for s in sets] for t in others]) @ coefficients
    assert model.langs == sorted(WORDS) and np.abs(model.scores(others) - want).max() < 2e-3


def test_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language_id(rows).join(rows.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == rows.count() and (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    test = got[got.held_out]
    assert len(test) > 2000 and (test.lang == test.lang_pred).mean() > 0.995


def test_rows_that_are_odd(spark):
    rows = made(300, 4)
    known = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... ²½ 😀", "bb"), (None, "tha wer ing", "aa"), (1003, "Tha WER " * 100_000, None), (1004, "ouai quel ère", "??"), (1005, "x", None), (7, rows[7][1], "aa"), (1006, None, "dd")]
    df = spark.createDataFrame([(i, t, lang, 0, "q") for i, t, lang in rows + odd], "doc_id long, text string, lang string, key int, grams string")
    got = language_id(df).toPandas()
    assert len(got) == len(rows) + len(odd) and (got.doc_id == 7).sum() == 2
    by = got[got.doc_id > 999].set_index("doc_id")
    assert by.lang_pred[[1000, 1001, 1002, 1006]].eq("und").all() and by.score[[1000, 1001, 1002]].eq(0).all()
    assert by.lang_pred[1003] == "aa" and got[got.doc_id.isna()].lang_pred.tolist() == ["aa"] and not got[got.doc_id.isna()].held_out.any()
    assert (got[got.doc_id.isin(range(300))].merge(df.toPandas()[:300][["doc_id", "lang"]], on="doc_id").eval("lang_pred == lang")).mean() > 0.99
    # only rows that are not held out teach a language
    taught = spark.createDataFrame([(i, t, "new" if i not in known else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    assert "new" not in set(language_id(taught).toPandas().lang_pred)
    assert language_id(df.limit(0)).collect() == []
    assert [tuple(x) for x in predict(df.filter("doc_id = 1004"), None).collect()] == [(1004, zlib.crc32(b"1004") % 4 == 2, "und", 0.0)]
