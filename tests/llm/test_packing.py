import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sightline.llm.packing import Encoder, divide, karmarkar_karp, pack

TEXTS = ["", " ", "a", "a  b\n\n c", "it's 'LL we'll", "é²³¼ x\x85\xa0y \t\n", "日本語 text", "x<|endoftext|>y <|endoftext", "\U0001f600", "a\x1cb \x1f c", "ǅ ɏ ɐ", "12 345a6", "...  !? ", " x   y", "\x00\r\n\r\n z  "]


def read(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def test_ids_are_the_tokenizers(spark):
    """On made-up texts, on very long ones and on all documents of the largest table."""
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = Encoder(read("byte_bpe_50k.json"), read("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(0)
    texts = TEXTS + ["".join(r.choice("aAbé'sltd 12²\n\t .,!\x85\xa0ß日") for _ in range(r.randrange(60))) for _ in range(500)]
    texts += [" " * 2_000_000 + "x", "a" * 300_000, "é . " * 100_000]
    texts += [x[0] or "" for x in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    assert len(texts) > 10_000
    for text in texts:
        assert np.frombuffer(encoder(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text[:200])


def test_differencing():
    r = np.random.default_rng(1)
    for ways, n in [(1, 5), (2, 9), (7, 60), (128, 900)]:
        sizes = r.integers(1, 257, n)
        part = karmarkar_karp(sizes, ways)
        sums = np.bincount(part, weights=sizes, minlength=ways)
        assert part.min() >= 0 and part.max() < ways and sums.sum() == sizes.sum()
        if n > 5 * ways:
            assert sums.max() - sums.min() <= 24
    assert sorted(np.bincount(karmarkar_karp(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    part = divide(np.array([600, 600, 600]), 1024)
    assert np.bincount(part, weights=[600] * 3).max() <= 1024 and part.max() == 2
    assert divide(np.zeros(0, np.int64), 10).tolist() == []


def test_pieces_hold_each_id_once(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    rows = list(enumerate(TEXTS + [None, "word " * 5000] + [" ".join(r.choice(["alpha", "beta", "g"]) for _ in range(r.randrange(900))) for _ in range(150)]))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as packet", "3 as start")
    got = pack(df).toPandas()
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    assert set(got.doc_id) == set(want)
    for key, part in got[got.doc_id != rows[3][0]].groupby("doc_id"):
        part = part.sort_values("start")
        assert (part.start == part.length.cumsum() - part.length).all() and part.length.sum() == len(want[key])
        assert (part.doc_tokens == len(want[key])).all()
        for x in part.itertuples():
            assert x.ids_crc32 == zlib.crc32(np.array(want[key][x.start : x.start + x.length], "<u4").tobytes())
    assert (got.doc_id == rows[3][0]).sum() == 2
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all() and part.length.sum() <= 1024
    assert got.length.sum() >= 0.97 * 1024 * got.sequence_id.nunique()
    assert pack(df.limit(0)).collect() == []
