import random

import public_tokenizers

from sightline.llm.token_counts import END, Automaton, read_vocabulary, token_counts, words_of


def greedy(word, pieces):
    left, count = (*word.encode(), END), 0
    while left and left != (END,):
        size = next((k for k in range(len(left), 0, -1) if left[:k] in pieces), 0)
        if not size:
            return 1
        left, count = left[size:], count + 1
    return count


def test_small_vocabularies():
    r = random.Random(0)
    for _ in range(60):
        pieces = {tuple(r.choice(b"abc") for _ in range(r.randrange(1, 6))) + ((END,) if r.random() < 0.4 else ()) for _ in range(r.randrange(1, 25))}
        automaton = Automaton(sorted(pieces))
        for _ in range(60):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randrange(1, 14)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_public_vocabulary(spark):
    pieces = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    known, r = set(pieces), random.Random(1)
    assert len(pieces) > 49_000
    texts = [None, "", " \n", "It's 2024, HELLO world!!", "é日本語 İstanbul ﬁ", "\U0001f600ab", "x" * 3000, "é"]
    texts += [" ".join("".join(r.choice("etaoinshré") for _ in range(r.randrange(1, 12))) for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(4, texts[4], 3)], "doc_id long, text string, n_tokens int")
    got = token_counts(df).collect()
    want = [(i, len(words_of(t or "")), sum(greedy(w, known) for w in words_of(t or ""))) for i, t in [*enumerate(texts), (4, texts[4])]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_counts(df.limit(0)).collect() == []
