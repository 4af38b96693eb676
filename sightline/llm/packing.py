"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) first give whole windows; what is left is cut into small pieces. Pieces are dealt at
random into groups of about GROUP windows, and each group is divided by the multiway differencing method: partial
partitions with opposing imbalances are merged, largest imbalance first, until one near-equal partition is left. If its
fullest window is over the capacity, the group is divided anew into one window more.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, giving_back, in_small_batches

CAPACITY = 1024
#: Largest piece of what is left after whole windows: small enough for near-equal sums.
PIECE = 256
#: Windows in a group that one call divides.
GROUP = 128

_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer's file, as little-endian unsigned 32-bit bytes.

    A faster library with the same ranks takes Latin texts, whose characters both class alike. The tokenizer's own takes
    all others: those beyond U+024F, those with the special token's string (one id), and those whose white space is too
    long for the faster one's pattern.
    """

    def __init__(self, tokenizer_file: bytes, ranks_file: bytes, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks_file.splitlines() if line)}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.own = Tokenizer.from_str(tokenizer_file.decode())

    def __call__(self, text: str) -> bytes:
        if not _BEYOND_LATIN.search(text) and SPECIAL not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # the pattern's stack is too small for a very long run of white space
                pass
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[int, Encoder] = {}


def _pieces(files, pattern: str, end_id: int, capacity: int, piece: int):
    def run(batches):
        tokenizer, ranks = files.value
        which = zlib.crc32(tokenizer + ranks + pattern.encode())
        encoder = _encoders.get(which) or _encoders.setdefault(which, Encoder(tokenizer, ranks, pattern))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []

            def put(i, a, n, ids, row=row, start=start, length=length, crc=crc, total=total):
                row.append(i)
                start.append(a)
                length.append(n)
                crc.append(zlib.crc32(ids[4 * a : 4 * (a + n)]))
                total.append(len(ids) // 4)

            for i, text in enumerate(batch.column(1)):
                ids = memoryview(encoder(text.as_py() or "") + end)
                n = len(ids) // 4
                whole = n - n % capacity
                for a in range(0, whole, capacity):
                    put(i, a, capacity, ids)
                for a in range(whole, n, piece):
                    put(i, a, min(piece, n - a), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def karmarkar_karp(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The part (0 to ways - 1) of each size in a near-equal division by multiway differencing."""
    order = count()
    heap, made = [], []
    for i, size in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[0] = size
        heap.append((-int(size) if ways > 1 else 0, next(order), sums, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, left, a = heapq.heappop(heap)
        _, _, right, b = heapq.heappop(heap)
        sums = left + right[::-1]  # the fullest of one with the emptiest of the other
        at = np.argsort(-sums, kind="stable")
        sums = sums[at]
        made.append((a, b, at))
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), next(order), sums, len(sizes) + len(made) - 1))
    part = np.zeros(len(sizes), np.int64)
    if len(sizes) == 0:
        return part
    todo = [(heap[0][3], np.arange(ways))]
    while todo:
        node, parts = todo.pop()
        if node < len(sizes):
            part[node] = parts[0]
            continue
        a, b, at = made[node - len(sizes)]
        left = np.empty(ways, np.int64)
        left[at] = parts
        todo += [(a, left), (b, left[::-1])]
    return part


def divide(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Karmarkar-Karp into as few windows as it fills without going over the capacity."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part = karmarkar_karp(sizes, ways)
        if len(sizes) == 0 or np.bincount(part, weights=sizes).max() <= capacity:
            return part
        ways += 1


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        window = divide(pdf["length"].to_numpy(np.int64), capacity)
        pdf["sequence_id"] = 2 * (pdf["packet"].astype(np.int64) * (1 << 32) + window)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 0, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of each row's ids and their places.

    A row's ids are those of its whole text (null: none) and end_id; each id lies in exactly one piece. A sequence holds
    at most capacity ids; one filled by a single piece has an odd sequence_id. The tokenizer's file, and the same
    vocabulary as ranks, are read on the driver and broadcast (under 3 MB). Empty texts are one piece of one id; repeated
    rows are packed once each; other columns are ignored; an empty table gives no rows.
    """
    import public_tokenizers

    files = []
    for path in (tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")):
        with open(path, "rb") as file:
            files.append(file.read())
    files = docs.sparkSession.sparkContext.broadcast(tuple(files))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = cut(in_small_batches(docs).select("doc_id", "text").mapInArrow(giving_back(_pieces(files, pattern or public_tokenizers.PATTERN, end_id, capacity, piece)), rows))
    pieces = pieces.withColumn("uid", F.monotonically_increasing_id())
    # whole windows stay where they are; a group holds only pieces that are to be divided
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", 2 * F.col("uid") + 1).withColumn("offset", F.lit(0).cast("long")).drop("uid")
    rest = pieces.filter(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (GROUP * capacity)))
    rest = rest.withColumn("packet", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return rest.groupBy("packet").applyInPandas(_pack_group(capacity), rows + ", sequence_id long, offset long").unionByName(whole)
