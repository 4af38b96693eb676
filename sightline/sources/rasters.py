"""Made-up recordings as grey frames: each frame is drawn by the task that holds its row, from its place in the recording.

A recording is a row of segments. A segment is still (an even grey), moving (a test picture of drifting bars and a
bouncing block) or "object N" (an even grey that a block of N pixels crosses); sizes are those of a picture 640 pixels wide.
Noise differs from frame to frame and comes from the recording's and the frame's numbers, so a repeated task draws the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline import schemas
from sightline.sources import scenarios

#: Frames that are drawn, and leave a task, together; frames of one recording that one task draws.
TOGETHER = 256
FRAMES_A_TASK = 2_000
WIDE = 640
GREY, WHITE = 128.0, 235.0


@dataclass(frozen=True)
class Recording:
    name: str
    parts: tuple[tuple[str, float], ...]
    #: strength of the noise, as a picture 640 pixels wide would have it
    noise: int = 0


# The segments (scene, seconds) and noise of the ten recordings.
RECORDINGS = (
    Recording("clear event", (("still", 8.0), ("moving", 3.0), ("still", 6.0)), 12),
    Recording("person lies still", (("still", 3.0), ("moving", 2.0), ("still", 15.0)), 12),
    Recording("short moment", (("still", 10.0), ("moving", 0.5), ("still", 10.0)), 12),
    Recording("normal work", (("moving", 18.0),), 0),
    Recording("several events", (("still", 4.0), ("moving", 1.0), ("still", 5.0), ("moving", 2.0), ("still", 4.0), ("moving", 1.0), ("still", 3.0)), 12),
    Recording("heavy noise", (("still", 12.0), ("moving", 1.0), ("still", 12.0)), 30),
    Recording("middling object", (("still", 9.0), ("object 100", 2.0), ("still", 9.0)), 8),
    Recording("small object", (("still", 12.0), ("object 40", 1.0), ("still", 7.0)), 8),
    Recording("long, one event", (("still", 70.0), ("moving", 1.5), ("still", 48.5)), 10),
    Recording("long, two events", (("still", 25.0), ("moving", 1.0), ("still", 60.0), ("moving", 1.5), ("still", 32.5)), 10),
)


def segments(spark: SparkSession, recordings: tuple[Recording, ...] = RECORDINGS) -> DataFrame:
    """(video_id, name, noise, seq, scene, seconds)."""
    noise = spark.createDataFrame([(v, r.noise) for v, r in enumerate(recordings)], "video_id long, noise int")
    return scenarios.segments(spark, tuple((r.name, r.parts) for r in recordings)).join(F.broadcast(noise), "video_id")


def _bars(width: int, height: int, at: float) -> np.ndarray:
    """The moving picture after `at` seconds."""
    scale = width / WIDE
    y, x = np.mgrid[0:height, 0:width] / scale
    picture = 40 + 24 * (((x + 90 * at) // 80) % 8)
    picture = np.where((x + y - 160 * at) % 240 < 40, 220 - 0.2 * y, picture)
    left, top = abs((190 * at) % (2 * 560) - 560), abs((130 * at) % (2 * 280) - 280)
    return np.where((x >= left) & (x < left + 80) & (y >= top) & (y < top + 80), WHITE, picture)


def _covered(low: float, high: float, n: int) -> np.ndarray:
    """The share of each of n pixels that lies between low and high."""
    return np.clip(np.minimum(np.arange(n) + 1, high) - np.maximum(np.arange(n), low), 0.0, 1.0)


def picture(scene: str, at: float, share: float, width: int, height: int) -> np.ndarray:
    """A segment's picture after `at` seconds, a share of its length, without noise."""
    if scene == "still":
        return np.full((height, width), GREY)
    if scene == "moving":
        return _bars(width, height, at)
    kind, _, size = scene.partition(" ")
    if kind != "object" or not size.isdigit():
        raise ValueError(f"no such scene: {scene}")
    box = int(size) * width / WIDE
    left, top = share * (width + box) - box, (height - box) / 2
    cover = np.outer(_covered(top, top + box, height), _covered(left, left + box, width))
    return GREY * (1 - cover) + WHITE * cover


def _drawn(width: int, height: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part, data = batch.slice(start, TOGETHER), []
                for row in part.to_pylist():
                    image = picture(row["scene"], row["at"], row["share"], width, height)
                    if row["noise"]:
                        # pixels of the wide picture have noise of their own; one here is the mean of several
                        noise = np.random.Generator(np.random.Philox(key=[row["video_id"] & (1 << 64) - 1, row["idx"]])).standard_normal((height, width))
                        image = image + noise * row["noise"] / np.sqrt(3.0) * min(1.0, width / WIDE)
                    data.append(np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes())
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("video_id"), part.column("idx"), part.column("t_ms"), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array(data, pa.binary())], names=["video_id", "idx", "t_ms", "width", "height", "data"])

    return run


def frames(parts: DataFrame, width: int = 160, height: int = 90, fps: float = 15.0) -> DataFrame:
    """(video_id, idx, t_ms, width, height, data) of segments (video_id, noise, seq, scene, seconds).

    Frame idx shows what the recording has at idx / fps seconds. A segment of no length has no frames.
    """
    line = Window.partitionBy("video_id").orderBy("seq")
    rows = parts.withColumn("_end", F.sum("seconds").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("seconds"))
    first, last = F.ceil(F.round(F.col("_start") * fps, 6)), F.ceil(F.round(F.col("_end") * fps, 6)) - 1
    rows = rows.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")).filter("_first <= _last")
    rows = rows.withColumn("idx", F.explode(F.sequence("_first", "_last")))
    at = F.greatest(F.col("idx") / fps - F.col("_start"), F.lit(0.0))
    rows = rows.select("video_id", "idx", F.round(F.col("idx") * 1000 / fps).cast("long").alias("t_ms"), "scene", at.alias("at"), (at / F.col("seconds")).alias("share"), "noise")
    rows = rows.repartition(F.col("video_id"), F.expr(f"idx div {FRAMES_A_TASK}"))
    return rows.mapInArrow(_drawn(width, height), schemas.ANALYSIS_FRAME)
