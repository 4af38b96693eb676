"""Arrow kernels over rasters and sound: frame features and log-mel spectra. Decoding is left to pluggable sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID_W, GRID_H = 12, 8


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def block_motion(before: np.ndarray, after: np.ndarray, grid_w: int = GRID_W, grid_h: int = GRID_H) -> tuple[np.ndarray, float]:
    """Mean absolute difference of each grid cell (rounded, row by row) and the largest cell's share of 255."""
    h, w = after.shape
    diff = np.abs(after.astype(np.int64) - before.astype(np.int64))
    cell = (np.arange(h) * grid_h // h)[:, None] * grid_w + (np.arange(w) * grid_w // w)[None, :]
    total = np.bincount(cell.ravel(), weights=diff.ravel(), minlength=grid_w * grid_h)
    count = np.maximum(np.bincount(cell.ravel(), minlength=grid_w * grid_h), 1)
    mean = total / count
    return _half_up(mean).astype(np.int16), float(mean.max() / 255.0)


def difference_hash(image: np.ndarray) -> int:
    """64 bits over a 9 x 8 box average: bit b (row by row, lowest first) is set iff a cell is brighter than its right neighbour."""
    h, w = image.shape
    ys, xs = np.arange(9) * h // 8, np.arange(10) * w // 9
    sums = np.pad(image.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, y1, x0, x1 = ys[:8, None], np.maximum(ys[1:9, None], ys[:8, None] + 1), xs[None, :9], np.maximum(xs[None, 1:10], xs[None, :9] + 1)
    y1, x1 = np.minimum(y1, h), np.minimum(x1, w)
    area = np.maximum((y1 - y0) * (x1 - x0), 1)
    box = (sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0]) // area
    bits = (box[:, :8] > box[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, grid, peak, mark = [], [], [], []
        for before, data, w, h in zip(*(batch.column(c) for c in ("before", "data", "width", "height"))):
            image = np.frombuffer(data.as_py(), np.uint8).reshape(h.as_py(), w.as_py())
            if before.is_valid:
                last = np.frombuffer(before.as_py(), np.uint8).reshape(image.shape)
                cells, top = block_motion(last, image)
                raw.append(float(np.abs(image.astype(np.int64) - last).sum() / (image.size * 255.0)))
            else:
                cells, top = np.zeros(GRID_W * GRID_H, np.int16), 0.0
                raw.append(0.0)
            grid.append(cells.tolist())
            peak.append(top)
            mark.append(difference_hash(image))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("video_id", "idx", "t_ms")] + [pa.array(raw, pa.float32()), pa.array(mark, pa.int64()), pa.array(grid, pa.list_(pa.int16())), pa.array(peak, pa.float32())], names=["video_id", "idx", "t_ms", "raw", "dhash", "grid", "cell_peak"])


def frame_features(frames: DataFrame) -> DataFrame:
    """(video_id, idx, t_ms, raw, dhash, grid, cell_peak) of grey frames (video_id, idx, t_ms, width, height, data)."""
    line = Window.partitionBy("video_id").orderBy("idx")
    pairs = frames.withColumn("before", F.lag("data").over(line)).select("video_id", "idx", "t_ms", "width", "height", "data", "before")
    return pairs.mapInArrow(_features, "video_id long, idx long, t_ms long, raw float, dhash long, grid array<smallint>, cell_peak float")


def mel_of(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def hz_of(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def scaled_size(width: Column, height: Column, most: int) -> Column:
    """(width, height) with the longest side at most `most`, never larger than before and at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1).cast("long"), F.floor(x * scale + 0.5).cast("long"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def image_tokens(width: Column, height: Column, tile: int = 28) -> Column:
    return (F.ceil(width / tile) * F.ceil(height / tile)).cast("long")


def payload_estimate(width: Column, height: Column, duration_ms: Column, fps: Column, sent_frames: Column) -> Column:
    """What sending a clip's frames costs and saves: (per_frame, frames_total, source_frames, sent_frames, ratio, tokens_if_naive).

    width and height are those that are sent; ratio is source frames over sent ones (over 1 if none are sent).
    """
    per_frame, source = image_tokens(width, height), F.floor(duration_ms / F.lit(1000.0) * fps + 0.5).cast("long")
    sent = sent_frames.cast("long")
    return F.struct(per_frame.alias("per_frame"), (per_frame * sent).alias("frames_total"), source.alias("source_frames"), sent.alias("sent_frames"), (source / F.greatest(sent, F.lit(1))).alias("ratio"), (source * per_frame).alias("tokens_if_naive"))


def alignment(a: np.ndarray, b: np.ndarray, search: int = 4096, span: int = 160_000) -> tuple[int, float, float]:
    """(shift, residual, relative): the shift of b within `search` samples that correlates best with a, the root mean square
    of what differs then, and its share of a. The first second of a is left out, or a quarter of a shorter one."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    base = min(16_000, len(a) // 4)
    span = max(1, min(span, len(a) - base - search))
    part = a[base : base + span]
    # b from base - search on, with silence beyond its ends
    around = np.zeros(len(part) + 2 * search)
    low, high = max(0, base - search), max(0, min(len(b), base + len(part) + search))
    if high > low:
        around[low - (base - search) : high - (base - search)] = b[low:high]
    size = 1 << int(len(around) + len(part)).bit_length()
    dots = np.fft.irfft(np.fft.rfft(around, size) * np.conj(np.fft.rfft(part, size)), size)[: 2 * search + 1]
    shift = int(np.argmax(np.round(dots, 6))) - search
    at = np.arange(base, base + len(part)) + shift
    met = (at >= 0) & (at < len(b))
    off, own = part[met] - b[at[met]], part[met]
    energy = float(own @ own)
    return shift, float(np.sqrt(off @ off / span)), float(np.sqrt(off @ off / energy)) if energy > 0 else 0.0


def aligned(pairs: DataFrame) -> DataFrame:
    """(video_id, shift, residual, relative) of pairs of decoded sounds (video_id, a, b)."""

    def run(batches):
        for batch in batches:
            found = [alignment(np.array(a.as_py() or [0.0]), np.array(b.as_py() or [0.0])) for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], names=["video_id", "shift", "residual", "relative"])

    return pairs.select("video_id", "a", "b").mapInArrow(run, "video_id long, shift long, residual double, relative double")


def window_floor(levels: DataFrame, window: int, top_db: float = 120.0) -> DataFrame:
    """(video_id, w, place, level): levels (video_id, idx, level) in windows of `window` samples, none lower than top_db below
    its window's best; a last window that the levels don't fill is filled with that floor."""
    line = Window.partitionBy("video_id", "w")
    rows = levels.select("video_id", F.expr(f"idx div {window}").alias("w"), F.expr(f"idx % {window}").alias("place"), "level")
    floor = F.max("level").over(line) - top_db
    inside = rows.select("video_id", "w", "place", F.greatest("level", floor).alias("level"))
    short = rows.groupBy("video_id", "w").agg((F.max("level") - top_db).alias("level"), (F.max("place") + 1).alias("n")).filter(F.col("n") < window)
    filled = short.select("video_id", "w", F.explode(F.sequence(F.col("n"), F.lit(window - 1).cast("long"))).alias("place"), "level")
    return inside.unionByName(filled)


def mel_filters(bands: int, size: int, rate: int, low: float, high: float) -> np.ndarray:
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(low), mel(high), bands + 2) / 2595.0) - 1.0)
    freq = np.arange(size // 2 + 1) * rate / size
    up = (freq[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - freq[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0.0, np.minimum(up, down))


def log_mel(samples: np.ndarray, rate: int = 16_000, size: int = 512, hop: int = 160, bands: int = 64) -> np.ndarray:
    """(frames, bands) in decibels: reflected edges, Hann window, power spectrum, mel bands, floor 1e-10."""
    if len(samples) < 2:
        return np.zeros((0, bands))
    x = np.pad(np.asarray(samples, np.float64), size // 2, mode="reflect" if len(samples) > size // 2 else "edge")
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    return 10.0 * np.log10(np.maximum(power @ mel_filters(bands, size, rate, 0.0, rate / 2).T, 1e-10))


def log_mel_frames(pcm: DataFrame) -> DataFrame:
    """(video_id, frame, mel) of sound (video_id, samples at 16 kHz mono)."""

    def run(batches):
        for batch in batches:
            for key, samples in zip(batch.column(0), batch.column(1)):
                mel = log_mel(np.array(samples.as_py() or [], np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(mel), pa.int64()), pa.array(range(len(mel)), pa.int64()), pa.array(mel.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["video_id", "frame", "mel"])

    return pcm.select("video_id", "samples").mapInArrow(run, "video_id long, frame long, mel array<float>")
