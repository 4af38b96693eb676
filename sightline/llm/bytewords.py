"""Vectorised word and n-gram hashing over Arrow text columns, used inside Spark tasks.

A batch of texts is one UTF-8 buffer with offsets. Word bounds, 64-bit word hashes and n-gram hashes come from
whole-buffer array operations, so a task works in chunks of a few megabytes whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a task works on (a longer document is one step of its own).
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_codes = np.arange(256)
#: Words are runs of anything but ASCII white space.
NOT_SPACE = ~np.isin(_codes, [0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and whatever lies beyond ASCII.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x41) & (_codes <= 0x5A)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about limit bytes; no document is split."""
    data, offsets = text_buffer(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a chunk of texts: starts, ends (byte places) and first (the number of the first word of each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            bounds = offsets[(offsets > 0) & (offsets < n)]
            before[bounds], after[bounds - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * up[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(_U))


_WEIGHTS = mix(np.arange(1, 65, dtype=_U) * _BASE) | _U(1)


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words; those that cross into another text are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.full(n, _U(int(k) * int(_BASE) & (2**64 - 1)), _U)
    for j in range(k):
        total += words[j : j + n] * _WEIGHTS[j]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
