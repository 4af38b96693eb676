"""Small reports drawn on the driver from rolled-up rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sightline.functions.clock import TICKS_MS

#: Most rows that are drawn: a chart is bucketed before.
MOST_ROWS = 5_000


def tick(duration_ms: int, wanted: int = 10) -> int:
    """The first interval that reaches a wanted-th of the duration, else the last; see clock.tick_interval()."""
    return next((t for t in TICKS_MS if t >= duration_ms // wanted), TICKS_MS[-1])


def svg(bucketed: DataFrame, width: int = 800, height: int = 160) -> str:
    """A line chart of one recording's buckets (t_ms, score, is_scene_cut), cuts as upright lines."""
    rows = bucketed.orderBy("t_ms").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} buckets: take longer ones")
    end = max((r.t_ms for r in rows), default=0) or 1
    x = lambda t: round(t * width / end, 1)
    y = lambda s: round(height - float(s) * height, 1)
    line = " ".join(f"{x(r.t_ms)},{y(r.score)}" for r in rows)
    cuts = "".join(f'<line class="cut" x1="{x(r.t_ms)}" x2="{x(r.t_ms)}" y1="0" y2="{height}"/>' for r in rows if r.is_scene_cut)
    ticks = "".join(f'<text x="{x(t)}" y="{height + 12}">{t // 1000}s</text>' for t in range(0, end + 1, tick(end)))
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height + 16}"><polyline points="{line}"/>{cuts}{ticks}</svg>'


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a table; a larger one raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [df.columns, ["-"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("|" + "|".join(x) + "|" for x in lines)
