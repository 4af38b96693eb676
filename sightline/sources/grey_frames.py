"""Uncompressed recordings as rows of grey frames: a data source over Y4M files and over PGM images one behind the other.

All frames of a file have the same number of bytes, so a file is cut into byte ranges of whole frames, one for each task,
and a time is found by its place. Filters on t_ms reach the source: only the bytes of the frames that they leave are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from sightline.sources.folders import open_store, qualified

NAME = "grey_frames"
SCHEMA = "path string, idx bigint, t_ms bigint, width int, height int, data binary"
#: Bytes of a task's range, and frames that leave a task together.
RANGE_BYTES = 32 << 20
TOGETHER = 64
HEADER_BYTES = 4096

# Bytes of colour behind the grey plane, as shares of its pixels (rows and columns each rounded up), by Y4M's colour names.
COLOUR = {"mono": (0, 1, 1), "420": (2, 2, 2), "422": (2, 1, 2), "444": (2, 1, 1)}


@dataclass(frozen=True)
class Layout:
    """How a file's frames lie: from `start` on, each with `mark` before `width` * `height` grey bytes and `rest` more."""

    start: int
    mark: bytes
    width: int
    height: int
    rest: int
    fps: float

    @property
    def step(self) -> int:
        return len(self.mark) + self.width * self.height + self.rest

    def t_ms(self, idx: int) -> int:
        return math.floor(idx * 1000 / self.fps + 0.5)


def layout(head: bytes, fps: float) -> Layout:
    """The layout told by a file's first bytes; fps is for formats that don't tell it. ValueError for any other format."""
    if head.startswith(b"YUV4MPEG2 "):
        line, _, behind = head.partition(b"\n")
        told = {x[:1]: x[1:] for x in line.decode("ascii", "replace").split(" ")[1:] if x}
        colour = COLOUR.get(re.match("mono|4[0-9]{2}|", told.get("C", "420"))[0])
        rate = re.fullmatch("([0-9]+):([0-9]+)", told.get("F", ""))
        if colour is None or re.search("p1[0-9]|mono[0-9]", told.get("C", "")) or not rate or not int(rate[1]) or not int(rate[2]):
            raise ValueError(f"not a Y4M header that can be read: {line[:80]!r}")
        width, height = int(told["W"]), int(told["H"])
        if behind and not behind.startswith(b"FRAME\n"):
            raise ValueError("frames of a Y4M file with parameters of their own can't be read")
        planes, down, across = colour
        return Layout(len(line) + 1, b"FRAME\n", width, height, planes * -(-height // down) * -(-width // across), int(rate[1]) / int(rate[2]))
    found = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*([0-9]+)\s+([0-9]+)\s+255\s", head)
    if not found:
        raise ValueError("neither a Y4M file nor 8-bit PGM images")
    return Layout(0, found[0], int(found[1]), int(found[2]), 0, fps)


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fps, self.range_bytes = options["path"], float(options.get("fps", 15)), int(options.get("range_bytes", RANGE_BYTES))
        self.low, self.high = 0, math.inf
        self.at = int(options["at_ms"]) if "at_ms" in options else None
        if self.at is not None:
            self.low = max(0, self.at)

    def pushFilters(self, filters: list[Filter]):
        """Bounds of t_ms are kept here; Spark still tests all filters."""
        for f in filters:
            if getattr(f, "attribute", None) == ("t_ms",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self):
        import pyarrow.fs

        store, path = open_store(self.path)
        info = store.get_file_info(path)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((f for f in store.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and f.extension in ("y4m", "pgm")), key=lambda f: f.path)
        out = []
        for file in files:
            with store.open_input_file(file.path) as data:
                own = layout(data.read(HEADER_BYTES), self.fps)
            frames, over = divmod(file.size - own.start, own.step)
            first = max(0, math.floor(self.low * own.fps / 1000) - 1)
            last = frames if self.high == math.inf else min(frames, math.ceil(self.high * own.fps / 1000) + 2)
            while first < last and own.t_ms(first) < self.low:
                first += 1
            while first < last and own.t_ms(last - 1) > self.high:
                last -= 1
            if self.at is not None:
                last = min(last, first + 1)
            each = max(1, self.range_bytes // own.step)
            out += [Range(file.path, own, i, min(i + each, last)) for i in range(first, last, each)]
            if over and self.high >= own.t_ms(frames) and (self.at is None or first == frames):
                out.append(Range(file.path, own, frames, frames + 1))
        return out

    def read(self, partition: Range | None):
        if partition is None:  # no ranges at all
            return
        store, _ = open_store(self.path)
        own, names = partition.layout, ("path", "idx", "t_ms", "width", "height", "data")
        with store.open_input_file(partition.path) as data:
            for start in range(partition.first, partition.last, TOGETHER):
                rows = []
                for idx in range(start, min(start + TOGETHER, partition.last)):
                    data.seek(own.start + idx * own.step)
                    whole = data.read(own.step)
                    if len(whole) < own.step:
                        raise ValueError(f"{partition.path} ends within frame {idx}: {len(whole)} of {own.step} bytes")
                    if not whole.startswith(own.mark):
                        raise ValueError(f"{partition.path} has no frame {idx} where it should begin")
                    rows.append((partition.path, idx, own.t_ms(idx), own.width, own.height, whole[len(own.mark) : len(own.mark) + own.width * own.height]))
                columns = list(zip(*rows))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class GreyFrames(DataSource):
    """Options: path (a file or a folder of .y4m and .pgm files), fps (of PGM images; 15), range_bytes (of a task), at_ms (only
    the first frame from then on)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def grey_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, idx, t_ms, width, height, data) of all frames below path. A file that ends within a frame is an error when that
    frame is read; a file without frames gives no rows."""
    spark.dataSource.register(GreyFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).options(**options).load(qualified(spark, path))


def grey_at(spark: SparkSession, path: str, t_ms: int, **options) -> DataFrame:
    """The first frame of each file that begins at a time or later, by reading that frame alone; none beyond the last one."""
    return grey_frames(spark, path, at_ms=t_ms, **options)
