import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sightline.llm import alignment
from sightline.llm.token_counts import byte_letters

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = byte_letters()


def groups_of(text):
    """[(A ids, B ids)] of a text's groups, one token after the other."""
    if not text:
        return []
    a, b = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) if all(c in LETTERS for c in A.id_to_token(i)) else A.id_to_token(i).encode() for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in b)]
    if b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
        return []
    out, at_a, at_b = [([], [])], 0, 0
    i = j = 0
    while i < len(a) or j < len(b):
        if at_a == at_b and out[-1] != ([], []):
            out.append(([], []))
        if at_a <= at_b:
            at_a += len(bytes_a[i])
            out[-1][0].append(a[i])
            i += 1
        else:
            at_b += len(bytes_b[j])
            out[-1][1].append(b[j])
            j += 1
    return out


def brute(rows):
    groups = [groups_of(t) for _, t in rows]
    counts = Counter(p for g in groups for p in {(a, b) for x, y in g for a in x for b in y})
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), g in zip(rows, groups):
        links = [(a, b) for x, y in g for a in x for b in y]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return sorted(out, key=str)


def made():
    r = random.Random(5)
    texts = [None, "", " ", "a", "  x \n\n y", "a▁b", "a\x00b", "<|endoftext|> <s>x</s> <unk>", "日本語 😀😀 text", "é é ﬁ ﻿", "é²³¼ \x85\xa0", "don't 123456 ====== ------", "\r\n\t", "=" * 300 + "x", "naïve " * 40]
    texts += ["".join(r.choice("abe'sltd 12\n\t.,!é\xa0ß日😀=") for _ in range(r.randrange(80))) for _ in range(200)]
    texts += [" ".join(r.choice(["alpha", "beta", "g", "tokenizer", "Ünïcode"]) for _ in range(r.randrange(60))) for _ in range(100)]
    rows = list(enumerate(texts)) + [(3, "a"), (None, "null id"), (None, None)] + [(900 + k, "the same copy") for k in range(40)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"LINKS": 40, "STEP": 500, "HELD": 300, "TEXTS": 200}])
def test_against_brute_force(spark, monkeypatch, limits):
    """Small limits: many steps, the weighted way for documents of many links, and counts passed on in between."""
    rows = made()
    if limits:
        batch = [(t or "") for _, t in rows]
        pair = alignment._pair((*(open(public_tokenizers.path(x), "rb").read() for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()))
        encoded = pair.encode(batch)
        import numpy as np

        sides = [[np.frombuffer(x[k], pair.kind()) for x in encoded] for k in (0, 1)]
        whole = alignment.Aligned(*sides, pair.lengths)
        (keys, none), = whole.links()
        assert none is None
        for name, value in limits.items():
            monkeypatch.setattr(alignment, name, value)
        parts = list(whole.links())
        assert len(parts) > 5 and sum(int(n.sum()) for _, n in parts) == len(keys)
        summed = Counter()
        for k, n in parts:
            for x, y in zip(k.tolist(), n.tolist()):
                summed[x] += y
        assert summed == Counter(keys.tolist()) and sum(len(set(k.tolist())) for k, _ in parts) == len(summed)
        return
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, a string, n_links int").repartition(5)
    assert sorted((tuple(x) for x in alignment.align(df).collect()), key=str) == brute(rows)


def test_words_are_encoded_once(monkeypatch):
    """By words as by whole texts, with little room for words; what is remembered is not encoded again."""
    monkeypatch.setattr(alignment, "WORDS", 50)
    pair = alignment.Pair(*(open(public_tokenizers.path(x), "rb").read() for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    texts = [t or "" for _, t in made()] + ["x \u0301y z", "a\n\n b", " lead", "trail ", "two  blanks", "w" * 99 + " v", "a\u200b b", "ﬁ ﬁ", "\n", "a \nb\n c"]
    whole = pair.whole(texts)
    for size in (1, 7, len(texts)):
        assert [x for i in range(0, len(texts), size) for x in pair.encode(texts[i : i + size])] == whole
    assert pair.by_words and len(pair.words) == 50 and max(map(len, pair.words)) <= alignment.LONGEST
    monkeypatch.setattr(alignment, "WORDS", 1 << 17)
    first, asked = pair.encode(["alpha beta gamma " * 9]), []
    monkeypatch.setattr(pair, "_apart", lambda words: asked.append(words))
    assert pair.encode(["alpha beta gamma " * 9]) == first and not asked


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(df).collect() == []
    only = spark.createDataFrame([("q", None), ("r", "")], "doc_id string, text string")
    assert sorted(tuple(x) for x in alignment.align(only).collect()) == [("q", 0, 0, 0, 0, 0, 0, ""), ("r", 0, 0, 0, 0, 0, 0, "")]


def test_very_long_text(spark):
    rows = [(1, "a long tale of words, " * 20_000), (2, "é" * 50_000), (3, "=" * 70_001 + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: tuple(x) for x in alignment.align(df).collect()}
    assert sorted(got.values(), key=str) == brute(rows)
