"""Lengths of WAV and MP4 recordings from their headers alone: boxes and chunks are walked by seeking, media data is not read."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sightline.sources.folders import open_store

#: Tables of a track that are longer than this are not read (a length from its other estimate stands).
MOST_BYTES = 64 << 20


def _boxes(file: BinaryIO, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the content, end) of MP4 boxes."""
    at = start
    while at + 8 <= end:
        file.seek(at)
        size, kind = struct.unpack(">I4s", file.read(8))
        content = at + 8
        if size == 1:
            (size,) = struct.unpack(">Q", file.read(8))
            content += 8
        elif size == 0:
            size = end - at
        if size < content - at or at + size > end:
            return
        yield kind, content, at + size
        at += size


def _within(file: BinaryIO, start: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
    for kind, a, b in _boxes(file, start, end):
        if kind == path[0]:
            yield from _within(file, a, b, *path[1:]) if path[1:] else [(a, b)]


def _read(file: BinaryIO, a: int, b: int) -> bytes:
    file.seek(a)
    return file.read(min(b - a, MOST_BYTES))


def _track_seconds(file: BinaryIO, a: int, b: int) -> float:
    """The longer of what a track says of itself and of what its frames add up to."""
    said = counted = 0.0
    scale = 0
    for x, y in _within(file, a, b, b"mdia", b"mdhd"):
        head = _read(file, x, min(y, x + 36))
        long = head[0] == 1
        scale, length = struct.unpack(">IQ", head[20:32]) if long else struct.unpack(">II", head[12:20])
        unknown = (1 << 64) - 1 if long else (1 << 32) - 1
        said = length / scale if scale and length != unknown else 0.0
    for x, y in _within(file, a, b, b"mdia", b"minf", b"stbl", b"stts"):
        table = _read(file, x, y)
        (n,) = struct.unpack(">I", table[4:8])
        n = min(n, (len(table) - 8) // 8)
        pairs = struct.unpack(f">{2 * n}I", table[8 : 8 + 8 * n])
        counted = sum(c * d for c, d in zip(pairs[::2], pairs[1::2])) / scale if scale else 0.0
    return max(said, counted)


def mp4_seconds(file: BinaryIO, size: int) -> float | None:
    found = [_track_seconds(file, a, b) for a, b in _within(file, 0, size, b"moov", b"trak")]
    return max(found, default=0.0) or None


def wav_seconds(file: BinaryIO, size: int) -> float | None:
    """By bytes a second, and by frames over the rate; the data's length is at most what the file has."""
    file.seek(0)
    if file.read(12)[8:] != b"WAVE":
        return None
    at, rate, speed, frame, data, told = 12, 0, 0, 0, 0, 0
    while at + 8 <= size:
        file.seek(at)
        kind, length = struct.unpack("<4sI", file.read(8))
        if kind == b"fmt " and length >= 16:
            _, _, rate, speed, frame, _ = struct.unpack("<HHIIHH", file.read(16))
        elif kind == b"fact" and length >= 4:
            (told,) = struct.unpack("<I", file.read(4))
        elif kind == b"data":
            data = min(length, size - at - 8)
        at += 8 + length + length % 2
    frames = max(told, data // frame if frame else 0)
    return max(data / speed if speed else 0.0, frames / rate if rate else 0.0) or None


def seconds(file: BinaryIO, size: int) -> float | None:
    """A recording's length in seconds, null where the header doesn't tell it or says 0."""
    try:
        file.seek(0)
        head = file.read(12)
        if head[:4] == b"RIFF":
            return wav_seconds(file, size)
        return mp4_seconds(file, size) if head[4:8] in (b"ftyp", b"moov", b"free", b"skip", b"wide", b"mdat") else None
    except (struct.error, IndexError):
        return None


def durations(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, duration_s) of paths (path): read where the rows are, by ranges of bytes. A file that isn't there has null."""

    def run(parts):
        for pdf in parts:
            out = []
            for path in pdf["path"]:
                store, name = open_store(path)
                try:
                    with store.open_input_file(name) as file:
                        out.append(seconds(file, file.size()))
                except FileNotFoundError:
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "duration_s": pd.Series(out, dtype="float64")})

    return paths.select("path").mapInPandas(run, "path string, duration_s double")
