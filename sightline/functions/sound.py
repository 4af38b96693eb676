"""Sound in pieces: mixing channels down and changing the sampling rate.

A recording's sound is rows of consecutive pieces. A sample of the output depends on the input around its time alone, so
each piece is worked out with the edges of its neighbours, whatever task has them: pieces and the whole give the same samples.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Zero crossings of the filter on either side of a sample.
CROSSINGS = 16
#: Samples of the output that are worked out together.
TOGETHER = 1 << 14


def downmixed(samples: np.ndarray, channels: int) -> np.ndarray:
    """Interleaved samples as one channel: two are added and divided by the root of 2. ValueError for more, or for half a frame."""
    samples = np.asarray(samples, np.float32)
    if channels == 1:
        return samples
    if channels != 2:
        raise ValueError(f"sound of {channels} channels can't be mixed down")
    if len(samples) % 2:
        raise ValueError("stereo sound ends within a frame")
    return ((samples[0::2] + samples[1::2]) * np.float32(1 / np.sqrt(2.0))).astype(np.float32)


def half_width(source: int, target: int) -> int:
    """Input samples on either side that a sample of the output depends on."""
    return int(np.ceil(CROSSINGS * max(1.0, source / target)))


def resampled_part(samples: np.ndarray, begin: int, total: int, source: int, target: int, first: int, last: int) -> np.ndarray:
    """Output samples first to last - 1, from input samples that begin at number `begin` of `total`; beyond the sound is silence.

    A windowed sinc: sample k is the input around k * source / target, weighted. The weights depend on that place's
    fraction alone, of which there are target / gcd.
    """
    step, turns = source // gcd(source, target), target // gcd(source, target)
    width, cut = half_width(source, target), min(1.0, target / source)
    offsets = np.arange(-width, width + 1)
    out = np.empty(max(0, last - first), np.float32)
    padded = np.concatenate((np.zeros(2 * width + 2), np.asarray(samples, np.float64), np.zeros(2 * width + 2)))
    for at in range(first, last, TOGETHER):
        k = np.arange(at, min(at + TOGETHER, last))
        place, phase = (k // turns) * step + (k % turns) * step // turns, (k % turns) * step % turns
        apart = offsets[None, :] - (np.arange(turns) / turns)[np.unique(phase)][:, None]
        weights = cut * np.sinc(cut * apart) * np.where(np.abs(apart) <= width, 0.5 + 0.5 * np.cos(np.pi * apart / width), 0.0)
        row = np.searchsorted(np.unique(phase), phase)
        near = padded[np.clip(place[:, None] - begin + 2 * width + 2 + offsets[None, :], 0, len(padded) - 1)]
        out[at - first : at - first + len(k)] = (near * weights[row]).sum(axis=1)
    return out


def output_length(samples: int, source: int, target: int) -> int:
    return samples * target // source


def resampled(pieces: DataFrame, target: int) -> DataFrame:
    """(video_id, seq, start, samples): the pieces' sound as one channel at `target` samples a second; start numbers them.

    pieces are (video_id, seq, rate, channels, samples), interleaved and in order of seq, all of one rate. A recording of n
    samples gives n * target / rate of them, cut to a whole number. Only edges of neighbours are shuffled with a piece; a
    piece other than the last must be as long as an edge (ValueError). A null piece counts as empty and must be the last.
    """
    line = Window.partitionBy("video_id").orderBy("seq")
    whole = Window.partitionBy("video_id")
    size = (F.coalesce(F.size("samples"), F.lit(0)) / F.col("channels")).cast("long")
    rows = pieces.withColumn("samples", F.coalesce("samples", F.array().cast("array<float>"))).withColumn("_n", F.greatest(size, F.lit(0).cast("long")))
    rows = rows.withColumn("_begin", F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_total", F.sum("_n").over(whole)).withColumn("_same", (F.min("rate").over(whole) == F.max("rate").over(whole)) & (F.min("channels").over(whole) == F.max("channels").over(whole)))
    edge = (F.ceil(F.lit(CROSSINGS) * F.greatest(F.lit(1.0), F.col("rate") / target)) + 2).cast("int") * F.col("channels")
    tail = F.slice("samples", F.greatest(F.size("samples") - edge + 1, F.lit(1)), edge)
    head = F.slice("samples", F.lit(1), edge)
    rows = rows.withColumn("_before", F.lag(tail).over(line)).withColumn("_after", F.lead(head).over(line)).withColumn("_rest", F.col("_total") - F.col("_begin") - F.col("_n"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["_same"]:
                    raise ValueError(f"recording {r['video_id']} has pieces of different rates or channels")
                edge, source, begin = half_width(r["rate"], target) + 2, r["rate"], r["_begin"]
                if r["_n"] < edge and (0 < r["_rest"]) and begin + r["_n"] > 0:
                    raise ValueError(f"piece {r['seq']} of recording {r['video_id']} is shorter than {edge} samples")
                before, own, after = (downmixed(x or [], r["channels"]) for x in (r["_before"], r["samples"], r["_after"]))
                whole = np.concatenate((before, own, after))
                end, most = begin + r["_n"], output_length(r["_total"], source, target)
                # the output samples whose places lie in this piece
                first, last = (min(most, -(-x * target // source)) for x in (begin, end))
                last = most if r["_rest"] == 0 else last
                part = resampled_part(whole, begin - len(before), r["_total"], source, target, first, last)
                out.append((r["video_id"], r["seq"], first, part))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["video_id", "seq", "start", "samples"]), schema=pa.schema([("video_id", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("samples", pa.list_(pa.float32()))]))

    return rows.select("video_id", F.col("seq").cast("long").alias("seq"), F.col("rate").cast("long").alias("rate"), F.col("channels").cast("long").alias("channels"), "samples", "_n", "_begin", "_total", "_rest", "_same", "_before", "_after").mapInArrow(run, "video_id long, seq long, start long, samples array<float>")
