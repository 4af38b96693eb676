"""Clock texts, time parsing and clip time mappings. The formats differ in padding and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(x: Column) -> Column:
    text = x.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def report_clock(ms: Column) -> Column:
    """Milliseconds as MM:SS, from one hour on as HH:MM:SS."""
    s = F.expr("1000")
    total = F.floor(ms / s)
    return F.when(total >= 3600, F.concat_ws(":", _two(F.floor(total / 3600)), _two(F.floor(total / 60) % 60), _two(total % 60))).otherwise(F.concat_ws(":", _two(F.floor(total / 60)), _two(total % 60)))


def finding_clock(sec: Column) -> Column:
    """Seconds as MM:SS, from one hour on as H:MM:SS; negative is 0."""
    total = F.floor(F.greatest(sec, F.lit(0.0)))
    return F.when(total >= 3600, F.concat_ws(":", F.floor(total / 3600).cast("string"), _two(F.floor(total / 60) % 60), _two(total % 60))).otherwise(F.concat_ws(":", _two(F.floor(total / 60)), _two(total % 60)))


def minute_clock(sec: Column) -> Column:
    """Seconds as MM:SS with unbounded minutes."""
    total = F.floor(F.greatest(sec, F.lit(0.0)))
    return F.concat_ws(":", _two(F.floor(total / 60)), _two(total % 60))


def player_clock(sec: Column, tenths: bool = False) -> Column:
    """Seconds as MM:SS or, from one hour on, H:MM:SS, with the tenth cut off behind them if wanted; negative is 0."""
    safe = F.greatest(sec.cast("double"), F.lit(0.0))
    tenth = F.concat(F.lit("."), F.floor((safe % 1) * 10).cast("string")) if tenths else F.lit("")
    return F.concat(finding_clock(sec), tenth)


def tenth_clock(ms: Column) -> Column:
    """Milliseconds as MM:SS.d, the tenth cut off."""
    return F.concat(_two(F.floor(ms / 60000)), F.lit(":"), _two(F.floor(ms / 1000) % 60), F.lit("."), F.floor(ms / 100).cast("long").cast("string").substr(-1, 1))


def parse_clock(text: Column) -> Column:
    """MM:SS or HH:MM:SS as milliseconds; parts are trimmed numbers, cut to whole seconds; anything else is null."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.floor(F.trim(F.get(parts, F.lit(i))).try_cast("double"))
    a, b, c = number(0), number(1), number(2)
    return F.when(F.size(parts) == 2, (a * 60 + b) * 1000).when(F.size(parts) == 3, (a * 3600 + b * 60 + c) * 1000).cast("long")


def clip_to_source(ms: Column, t0: Column, t1: Column, scale: Column) -> Column:
    """A time in a stretched clip as a time in the recording, at most t1; a scale of 0 or less leaves it unstretched and unbounded."""
    return F.when(scale <= 0, t0 + ms).otherwise(F.least(t0 + F.round(ms / F.nullif(scale, F.lit(0.0))).cast("long"), t1))


def rebased_events(events: Column, t0: Column, t1: Column, scale: Column) -> Column:
    """Events of a clip (an array of structs with t_ms and time) with their times in the recording."""
    moved = lambda e: clip_to_source(e["t_ms"], t0, t1, scale)
    return F.transform(events, lambda e: e.withField("t_ms", moved(e)).withField("time", report_clock(moved(e))))


# Lengths of the intervals between ticks of a time axis.
TICKS_MS = (1_000, 2_000, 5_000, 10_000, 15_000, 30_000, 60_000, 120_000, 300_000, 600_000)


def tick_interval(duration_ms: Column, ticks: tuple[int, ...] = TICKS_MS, wanted: int = 10) -> Column:
    """The first interval that reaches a wanted-th of the duration, else the last."""
    known = F.array(*[F.lit(x).cast("long") for x in ticks])
    target = F.floor(duration_ms / wanted)
    return F.coalesce(F.array_min(F.filter(known, lambda c: c >= target)), F.lit(ticks[-1]).cast("long"))


def service_frames(seconds: Column, rate: float = 2.0) -> Column:
    """How many frames a model service takes from a clip of that length."""
    return F.floor(seconds * rate + 0.5).cast("long")


def frame_time(index: Column, fps: Column) -> Column:
    return F.round(index * 1000.0 / fps).cast("long")


def slow_motion(frames: Column, ms: Column) -> Column:
    """How far a clip must be stretched to give `frames` at 2 a second, at least 1."""
    return F.greatest(F.lit(1.0), F.coalesce(F.try_divide(frames / 2.0, ms / 1000.0), F.lit(1.0)))
