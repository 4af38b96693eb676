import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import brute as contaminated  # noqa: E402
from test_jaccard import brute as groups  # noqa: E402
from test_secrets import brute as secrets  # noqa: E402


@pytest.fixture()
def folder(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(4)]
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(r.randrange(60, 160))]
        if i % 6 == 0:
            words = [w + "###" for w in words]
        if i % 10 == 1:
            words[5:5] = items[i % 4][1].split()[:12]
        if i % 10 == 2:
            words.insert(9, f'token = "{i:040x}"')
        docs.append((i, " ".join(words), "en", f"s{i % 5}", 0))
        labels.append((i, int(i % 6 != 0), 0))
    docs += [(1000 + i, docs[i][1], "en", "s9", 0) for i in range(0, 240, 7)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "few words", "en", "s1", 9), docs[5]]
    out = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, docs, items


def test_each_stage(spark, folder):
    sf_dir, docs, items = folder
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5

    kept = stages[0](spark, df, sf_dir)
    assert kept.columns == df.columns
    rows = {(x.doc_id, x.text) for x in kept.collect()}
    assert rows == {(d, t) for d, t, *_ in docs if t and "###" not in t and len(t.split()) >= 50}

    single = stages[1](spark, kept, sf_dir)
    left = sorted(single.collect())
    names = {str(x[0]): x[2] for x in groups(sorted((d, t) for d, t in rows))}
    assert [x.doc_id for x in left] == sorted(d for d, _ in rows if names[str(d)] == d) and single.columns == df.columns

    clean = stages[2](spark, single, sf_dir)
    want = {x[0] for x in contaminated([(x.doc_id, x.text) for x in left], items) if not x[2]}
    assert {x.doc_id for x in clean.collect()} == want and len(want) < len(left)

    masked = stages[3](spark, clean, sf_dir)
    after = {x.doc_id: x for x in masked.collect()}
    assert set(after) == want and masked.columns == df.columns
    assert any("[SECRET]" in x.text for x in after.values())
    assert all(sum(secrets(x.text)[:3]) == 0 for x in after.values())
    assert all(after[x.doc_id].text == x.text for x in left if x.doc_id in after and "token" not in x.text)

    packed = stages[4](spark, masked, sf_dir).toPandas()
    assert set(packed.doc_id) == want
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_whole_run(spark, folder):
    sf_dir, _, _ = folder
    assert corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").count().count() > 50


def test_decisions_are_by_row(spark, folder):
    """Null and reused ids: contaminated texts and copies go whatever their id is, and take no other text along."""
    sf_dir, _, items = folder
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(*x, "en", "s", 0) for x in rows], columns)
    told = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)

    bad = text("p") + " " + items[0][1]
    rows = [(None, bad), (7, bad), (7, text("q")), (None, text("r"))]
    assert told(corpus_pipeline.decontamination_stage(spark, make(rows), sf_dir)) == sorted([(7, text("q")), (None, text("r"))], key=str)

    rows = [(5, text("a")), (5, text("b")), (3, text("b")), (9, text("a")), (None, text("a")), (None, text("c")), (None, text("c") + " end"), (None, ""), (None, ""), (8, ""), (8, "")]
    got = told(corpus_pipeline.near_duplicate_stage(spark, make(rows), sf_dir))
    c = [x for x in got if x[1].startswith("c0")]
    assert len(c) == 1 and c[0][1] in (text("c"), text("c") + " end")
    assert sorted((x for x in got if x not in c), key=str) == sorted([(5, text("a")), (3, text("b")), (None, ""), (None, ""), (8, "")], key=str)


def test_clashing_columns_empty_tables_and_rows_without_an_id(spark, folder):
    """Columns named as the stages' own ones come out unchanged; no rows give none."""
    sf_dir, _, items = folder
    extra = ["same", "k_same", "grouped", "nth", "n", "gone_same", "gone_doc_id", "s_doc", "r_doc", "r_ranges", "text_hash", "uid", "n_words"]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *[f"concat('x', doc_id) as `{c}`" for c in extra])
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == df.columns, name
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, plain, sf_dir)
    got = docs.collect()
    assert sorted((x.doc_id, x.text) for x in got) == sorted((x.doc_id, x.text) for x in plain.collect())
    assert all(x[c] == f"x{x.doc_id}" for x in got for c in extra)
    for start in (df.limit(0), df.withColumn("doc_id", F.lit(None).cast("long"))):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
        assert (docs.count() > 50) == bool(start.count())
        assert (corpus_pipeline.packing_stage(spark, docs, sf_dir).count() > 50) == bool(start.count())
