"""Alignment of two tokenizers: which token of one lies over which token of the other, and how many documents say so.

Both tokenizers cut the same bytes. Where tokens of both end, the bytes are cut into groups; two tokens that share a group
are linked. An id pair is one int64. Tasks count the documents of their pairs with np.unique; the partial counts are sorted
over the whole cluster by ranges of the key, and each range's runs are summed and written as one file of sorted keys and
counts to the shared folder. Documents look their pairs up in these files, which are mapped into memory, by bisection.

Each text is encoded once: ids are written to the shared folder in 16 bits each, where the vocabularies allow it. No token of
either side goes on behind a letter or sign and the blank after it, so words are encoded apart, each once for many texts.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Encoder
from .tables import in_small_batches, remove, shared_folder
from .token_counts import byte_letters

#: Bits of an id in a key; a key of a document within a step has the document's number above both ids.
BITS = 21
_LOW = (1 << BITS) - 1
#: Tokens of both sides, and links, that one step works on; a document with more is a step of its own.
STEP = 400_000
LINKS = 4_000_000
#: Keys that a task holds before it counts them, and different ones before it passes them on.
HELD = 4_000_000
#: Texts that are encoded at once: characters.
TEXTS = 1 << 20
#: Words, and characters of a word, that a worker remembers the ids of.
WORDS, LONGEST = 1 << 17, 32
#: A pattern by which a blank between two other characters begins a token, and the blanks that are taken to do so: those between
#: letters or signs that no character beside them is composed with.
BY_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BETWEEN = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
_PLAIN = re.compile("[!-~À-ɏ]+(?:\n+[!-~À-ɏ]+)*")

_ENCODED = "a binary, b binary"
_SHARD = "path string, rows long, first long, a int, best long"
_COUNTS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Both tokenizers, made from the bytes of their files, and each id's bytes."""

    def __init__(self, tokenizer_file: bytes, ranks_file: bytes, pattern: str, model_file: bytes):
        import sentencepiece

        self.a = Encoder(tokenizer_file, ranks_file, pattern)
        self.a.own.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_file)
        letters, vocabulary = byte_letters(), self.a.own.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > _LOW:
            raise ValueError(f"more than {_LOW} ids")
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.by_words = pattern == BY_BLANKS and not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))

    def kind(self) -> type:
        return np.uint16 if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else np.uint32

    def whole(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of each text by both; none where the joined bytes of a side are not a space and the text."""
        out, kind = [], self.kind()
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = b" " + text.encode()
            a = np.frombuffer(self.a(f" {text}"), "<u4") if text else ()
            same = text and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((a.astype(kind).tobytes(), np.array(b, kind).tobytes()) if same else (b"", b""))
        return out

    def _apart(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """whole() of plain words, encoded together and cut where the words end."""
        spaced = [b" " + w.encode() for w in words]
        text, ends = b"".join(spaced), np.cumsum([len(w) for w in spaced])
        sides = []
        for ids, known, lengths in zip((np.frombuffer(self.a(text.decode()), "<u4"), np.fromiter(chain.from_iterable(self.b.encode(words, num_threads=1)), np.uint32)), (self.bytes_a, self.bytes_b), self.lengths):
            if b"".join(map(known.__getitem__, ids.tolist())) != text:
                return self.whole(words)
            told = np.cumsum(lengths[ids])
            at = np.searchsorted(told, ends)
            if not np.array_equal(told[at], ends):
                return self.whole(words)
            size, all_ids = np.dtype(self.kind()).itemsize, ids.astype(self.kind()).tobytes()
            cuts = [0, *((at + 1) * size).tolist()]
            sides.append([all_ids[i:j] for i, j in zip(cuts, cuts[1:])])
        return list(zip(*sides))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """whole(), by words where both sides cut there. A text with a word that is not what it was goes through as a whole."""
        if not self.by_words:
            return self.whole(texts)
        cut, words = [_BETWEEN.split(t) for t in texts], self.words
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in words]
        room = WORDS - len(words)
        plain = dict.fromkeys(filter(_PLAIN.fullmatch, new))
        others = [w for w in new if w not in plain]
        words.update(zip(plain, self._apart(list(plain)) if plain else ()))
        words.update(zip(others, self.whole(others)))
        out = []
        for own in cut:
            a, b = zip(*map(words.__getitem__, own))
            out.append((b"".join(a), b"".join(b)) if all(a) else None)
        for w in new:
            if len(w) > LONGEST or room <= 0:
                del words[w]
            else:
                room -= 1
        odd = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = x
        return out


_pairs: dict[str, Pair] = {}


def _pair(files: tuple) -> Pair:
    which = hashlib.sha256(b"".join(x if isinstance(x, bytes) else x.encode() for x in files)).hexdigest()
    if which not in _pairs:
        _pairs[which] = Pair(*files)
    return _pairs[which]


def _encode(files):
    def run(batches):
        pair = _pair(files.value)
        for batch in batches:
            texts, at, encoded = [t or "" for t in batch.column(1).to_pylist()], 0, []
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= TEXTS:
                    size += len(texts[end])
                    end += 1
                encoded += pair.encode(texts[at:end])
                at = end
            a, b = (pa.array(x, pa.binary()) for x in zip(*encoded)) if encoded else (pa.array([], pa.binary()),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), a, b], names=["doc_id", "a", "b"])

    return run


class Aligned:
    """The groups of a step's documents: ids of both sides one document behind the other. A document ends a group."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], lengths: tuple[np.ndarray, np.ndarray]):
        self.a, self.b = (np.concatenate(x).astype(np.int64) for x in (a, b))
        self.docs = len(a)
        self.first_a, self.first_b = (np.append(0, np.cumsum([len(x) for x in side])) for side in (a, b))
        ends_a, ends_b = np.cumsum(lengths[0][self.a]), np.cumsum(lengths[1][self.b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        self.groups = len(ends)
        self.start_a, self.start_b = (np.searchsorted(g, np.arange(self.groups + 1)) for g in (self.group_a, self.group_b))
        self.in_a, self.in_b = np.diff(self.start_a), np.diff(self.start_b)
        self.first_group = np.append(self.group_a, self.groups)[self.first_a]
        self.n_links = int((self.in_a * self.in_b).sum())

    def links(self):
        """(key with the document's number, times) of all links, in parts that no pair of a document is in two of."""
        doc = np.repeat(np.arange(self.docs), np.diff(self.first_a))
        if self.n_links <= LINKS:
            yield self._with_b((doc << 2 * BITS) | (self.a << BITS), self.group_a, self.b, self.start_b), None
            return
        # equal ids of a group are put together, and the rest is worked through by ranges of the first id
        a, times_a = np.unique(np.stack((doc, self.a, self.group_a)), axis=1, return_counts=True)
        b, times_b = np.unique(np.stack((self.group_b, self.b)), axis=1, return_counts=True)
        start = np.searchsorted(b[0], np.arange(self.groups + 1))
        total = np.cumsum(np.diff(start)[a[2]])
        id_ends = np.append(np.flatnonzero(np.any(a[:2, 1:] != a[:2, :-1], axis=0)) + 1, a.shape[1])
        low = 0
        while low < a.shape[1]:
            most = (total[low - 1] if low else 0) + LINKS
            high = int(id_ends[max(np.searchsorted(id_ends, np.searchsorted(total, most, side="right"), side="right") - 1, np.searchsorted(id_ends, low, side="right"))])
            part = slice(low, high)
            keys = self._with_b((a[0, part] << 2 * BITS) | (a[1, part] << BITS), a[2, part], b[1], start)
            yield keys, np.repeat(times_a[part], np.diff(start)[a[2, part]]) * self._with_b(np.zeros(high - low, np.int64), a[2, part], times_b, start)
            low = high

    @staticmethod
    def _with_b(keys: np.ndarray, group: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Each key with all values of b in its group."""
        n = np.diff(start)[group]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(keys, n) + b[np.repeat(start[group], n) + within]

    def texts(self, names: list[str], ids_of_a: int) -> list[str]:
        """Each document's groups as `a1,a2|b1;a3|b2,b3`. names: A's ids and then B's, each with "," "|" and ";" behind."""
        places = np.arange(len(self.a)) + self.start_b[self.group_a], np.arange(len(self.b)) + self.start_a[self.group_b + 1]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[places[0]] = 3 * self.a
        codes[places[1]] = 3 * (ids_of_a + self.b)
        codes[places[0][self.start_a[1:] - 1]] += 1
        codes[places[1][self.start_b[1:] - 1]] += 2
        words = list(map(names.__getitem__, codes.tolist()))
        ends = self.first_a + self.first_b
        return ["".join(words[i:j])[:-1] for i, j in zip(ends, ends[1:])]


def _steps(batch, kind, lengths):
    """(first row, Aligned) of a batch's documents; each has tokens of both sides or none."""
    a, b = ([np.frombuffer(x, kind) for x in batch.column(k).to_pylist()] for k in ("a", "b"))
    at = 0
    while at < len(a):
        end, size = at + 1, len(a[at]) + len(b[at])
        while end < len(a) and size + len(a[end]) + len(b[end]) <= STEP:
            size += len(a[end]) + len(b[end])
            end += 1
        yield at, Aligned(a[at:end], b[at:end], lengths)
        at = end


def _partial_counts(shared):
    """(key, n): in how many of a task's documents a pair is linked; some pairs a few times over."""

    def told(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "n"])

    def summed(held):
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def run(batches):
        kind, lengths = shared.value
        held, size = [], 0
        for batch in batches:
            for _, step in _steps(batch, kind, lengths):
                for keys, _ in step.links():
                    keys, counts = np.unique(np.unique(keys) & (1 << 2 * BITS) - 1, return_counts=True)
                    held.append((keys, counts))
                    size += len(keys)
                    if size > HELD:
                        held = [summed(held)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield told(*held[0])
                            held, size = [], 0
        if held:
            keys, counts = summed(held)
            for i in range(0, len(keys), 1 << 18):
                yield told(keys[i : i + (1 << 18)], counts[i : i + (1 << 18)])

    return run


def _open_folder(uri: str):
    """The file system of a folder and its path there."""
    local = re.match("file:/+", uri)
    return (pa.fs.LocalFileSystem(), "/" + uri[local.end() :]) if local else pa.fs.FileSystem.from_uri(uri)


def _qualified(spark, folder: str) -> str:
    """The folder with its store's name, as Spark understands it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _write_shards(folder: str):
    """Sums the runs of a sorted range of (key, n), writes them as one file, keys first, and tells where, with the highest
    count of each first id. A file takes its place at once, so a repeated task does no harm."""

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = []
        for batch in batches:
            keys, counts = np.append(keys, batch.column(0).to_numpy()), np.append(counts, batch.column(1).to_numpy())
            if not len(keys):
                continue
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
            parts.append((keys[:-1], counts[:-1]))
            keys, counts = keys[-1:], counts[-1:]  # the last run may go on
        keys, counts = (np.concatenate([*x, y]) for x, y in zip(zip(*parts) if parts else ((), ()), (keys, counts)))
        if not len(keys):
            return
        store, path = _open_folder(folder)
        path, own = f"{path}/{TaskContext.get().partitionId():06d}.pairs", uuid.uuid4().hex
        store.create_dir(os.path.dirname(path))
        with store.open_output_stream(f"{path}.{own}") as out:
            out.write(keys.tobytes())
            out.write(counts.tobytes())
        store.move(f"{path}.{own}", path)
        starts = np.flatnonzero(np.append(True, keys[1:] >> BITS != keys[:-1] >> BITS))
        n = len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([len(keys)] * n, pa.int64()), pa.array([keys[0]] * n, pa.int64()), pa.array(keys[starts] >> BITS, pa.int32()), pa.array(np.maximum.reduceat(counts, starts), pa.int64())], names=["path", "rows", "first", "a", "best"])

    return run


class Shards:
    """Sorted count files, mapped into memory. Files of a store that can't be mapped are copied to a folder of this machine
    first; each reader can do so anew at any time."""

    def __init__(self, folder: str, shards: list[tuple[int, str, int]]):
        self.folder, self.shards = folder, sorted(shards)
        self.firsts = np.array([x[0] for x in self.shards], np.int64)
        self.open: dict[int, np.ndarray] = {}

    def _mapped(self, k: int) -> np.ndarray:
        if k not in self.open:
            store, _ = _open_folder(self.folder)
            path = self.shards[k][1]
            if not isinstance(store, pa.fs.LocalFileSystem):
                own = os.path.join(tempfile.mkdtemp(prefix="sightline-pairs-"), "pairs")
                pa.fs.copy_files(path, own, source_filesystem=store, destination_filesystem=pa.fs.LocalFileSystem())
                path = own
            self.open[k] = np.memmap(path, np.int64, "r", shape=(2, self.shards[k][2]))
        return self.open[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which are there."""
        out = np.empty(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                there = self._mapped(k)
                out[i:j] = there[1][np.searchsorted(there[0], keys[i:j])]
        return out


def _look_up(shared):
    def run(batches):
        kind, lengths, folder, shards, best = shared.value
        shards = Shards(folder, shards)
        names = [f"{i}{sep}" for x in lengths for i in range(len(x)) for sep in ",|;"]
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for _, step in _steps(batch, kind, lengths):
                sums = np.zeros((3, step.docs), np.int64)
                for keys, times in step.links():
                    different, at = np.unique(keys & (1 << 2 * BITS) - 1, return_inverse=True)
                    counts = shards.counts(different)
                    is_best = counts == best[different >> BITS]
                    cuts = np.searchsorted(keys >> 2 * BITS, np.arange(step.docs + 1))  # documents come in order
                    times = np.ones(len(keys), np.int64) if times is None else times
                    for row, x in enumerate((times, is_best[at] * times, counts[at] * times)):
                        sums[row] += np.diff(np.append(0, np.cumsum(x))[cuts])
                texts = step.texts(names, len(lengths[0]))
                for to, x in zip(out, (np.diff(step.first_a), np.diff(step.first_b), np.diff(step.first_group), *sums)):
                    to += x.tolist()
                out[6] += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def encoded_ids(docs: DataFrame, files, folder: str) -> DataFrame:
    """(doc_id, a, b): the ids of each row's text by both tokenizers, written once to folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = in_small_batches(docs).select("doc_id", "text").mapInArrow(_encode(files), f"doc_id {kind}, {_ENCODED}")
    return _written(rows, folder)


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def align(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs (doc_id, text).

    A is a byte-level BPE tokenizer (its file, and the same vocabulary as ranks), B a piece model; both encode a space and the
    whole text. n_links counts the linked token pairs, n_best those whose id pair is linked in as many rows of docs as any pair
    of its A id, count_sum sums these numbers of rows over the links. Rows whose text is null or empty, or not what the tokens
    of a side join to, have zeros and ''. Repeated rows count as often as they occur; other columns are ignored; an empty
    table gives no rows. Files of tokenizers are read on the driver (some 4 MB); ids and counts are written below
    spark.checkpoint.dir and stay there, as the result reads them.
    """
    import public_tokenizers as tokenizers

    spark = docs.sparkSession
    files = []
    for path in (tokenizer_path or tokenizers.path("byte_bpe_50k.json"), ranks_path or tokenizers.path("byte_bpe_50k.tiktoken"), model_path or tokenizers.path("piece_bpe_32k.model")):
        with open(path, "rb") as file:
            files.append(file.read())
    files = (files[0], files[1], pattern or tokenizers.PATTERN, files[2])
    pair = _pair(files)
    folder = _qualified(spark, f"{shared_folder(spark)}/sightline-alignment-{uuid.uuid4().hex}")
    rows = encoded_ids(docs, spark.sparkContext.broadcast(files), f"{folder}/ids")
    shared = spark.sparkContext.broadcast((pair.kind(), pair.lengths))
    # written, because bounds of ranges are found in a pass of their own
    counts = _written(rows.select("a", "b").mapInArrow(_partial_counts(shared), "key long, n long"), f"{folder}/partial")
    ranges = counts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_write_shards(f"{folder}/pairs"), _SHARD)
    told = _written(ranges, f"{folder}/shards")
    shards = [tuple(r) for r in told.select("first", "path", "rows").distinct().collect()]
    best = np.zeros(len(pair.bytes_a), np.int64)
    for a, most in told.groupBy("a").agg(F.max("best")).collect():
        best[a] = most
    remove(spark, f"{folder}/partial")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((pair.kind(), pair.lengths, f"{folder}/pairs", shards, best))
    return in_small_batches(rows).mapInArrow(_look_up(shared), f"doc_id {kind}, {_COUNTS}")
