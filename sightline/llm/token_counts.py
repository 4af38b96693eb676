"""Greedy word-piece counts by a linear automaton.

The vocabulary is one trie over bytes, with a mark for the end of a word. Each node knows how many pieces are popped
when the next byte leads nowhere, and the failure link to the node of what is left then; so a word is counted in one
pass over its bytes, without trying shorter and shorter pieces and without building any.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import giving_back, in_small_batches

END = 256
#: Words that a task remembers the counts of, and characters of the longest of them.
REMEMBERED = 500_000
LONGEST = 64

# The tokenizer's split of lower-case text into words, in full and for letters up to U+024F.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t\n\x0b\x0c\r \x85\xa0"
_LATIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces as byte tuples, with END after those that end a word, from a tokenizers JSON file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters, mark = byte_letters(), model.get("end_of_word_suffix") or ""
    out = []
    for piece in model["vocab"]:
        ends = bool(mark) and piece.endswith(mark)
        body = piece[: -len(mark)] if ends else piece
        if body and all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *([END] if ends else [])))
    return out


class Automaton:
    """Counts the pieces of greedy longest-match-first tokenization of a word.

    A word end that is left over alone costs nothing. A word with a byte that no piece starts with counts as one piece.
    """

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in [*pieces, (END,)]:
            node = 0
            for symbol in piece:
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    is_piece.append(False)
                node = self.next[node][symbol]
            is_piece[node] = True
        n = len(self.next)
        #: pieces popped at a dead end, and the node of what is left; -1: none, the word is not in the vocabulary
        self.popped, self.fail = [0] * n, [-1] * n
        end_alone = self.next[0][END]
        queue = deque((0, symbol, node) for symbol, node in self.next[0].items())
        while queue:
            parent, symbol, node = queue.popleft()
            if is_piece[node]:
                self.popped[node], self.fail[node] = int(node != end_alone), 0
            else:
                count, at = self.popped[parent], self.fail[parent]
                while at >= 0 and symbol not in self.next[at]:
                    count, at = count + self.popped[at], self.fail[at]
                if at >= 0:
                    self.popped[node], self.fail[node] = count, self.next[at][symbol]
            queue.extend((node, s, v) for s, v in self.next[node].items())

    def count(self, word: str) -> int:
        after, popped, fail = self.next, self.popped, self.fail
        node = total = 0
        for symbol in (*word.encode(), END):
            while symbol not in after[node]:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = after[node][symbol]
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def words_of(text: str) -> list[str]:
    """Composed, lower-case text split as the tokenizer does."""
    text = unicodedata.normalize("NFC", text).lower()
    if _BEYOND_LATIN.search(text):
        import regex

        return regex.findall(SPLIT, text)
    return _LATIN_SPLIT.findall(text)


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        found = self.automaton.count(word)
        if len(word) <= LONGEST and len(self) < REMEMBERED:
            self[word] = found
        return found


def _run(automaton):
    def run(batches):
        counts = _Counts(automaton.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or "")
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of docs (doc_id, text), over whole texts.

    vocabulary is the path of a tokenizers JSON file, read on the driver; its automaton is broadcast. Null and empty
    texts count 0; repeated rows come back once each; other columns are ignored; an empty table gives no rows.
    """
    import public_tokenizers

    pieces = read_vocabulary(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(giving_back(_run(automaton)), f"doc_id {kind}, n_words long, n_tokens long")
