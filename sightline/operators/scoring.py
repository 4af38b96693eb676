"""Scores of windows by a model that takes padded batches and may run out of memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sightline import schemas

#: Most frames of a window that a model takes.
MOST_FRAMES = 1012
# What tells in an error's text that memory was short.
MEMORY_MARKS = ("887a0006", "887a0005", "out of memory", "cudamalloc", "oom", "device hung")

Model = Callable[[np.ndarray], np.ndarray]


def is_memory_pressure(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or any(mark in str(error).lower() for mark in MEMORY_MARKS)


def scored(model: Model, windows: list[np.ndarray], batch: int, fill: float = 0.0) -> tuple[np.ndarray, int]:
    """The scores of windows (bands, frames), and the batch size that was used.

    Windows of a batch are padded to its longest with fill. On an error that tells of short memory all begins anew with
    batches half as large; with batches of one, or on any other error, it is raised.
    """
    if any(w.shape[1] > MOST_FRAMES for w in windows):
        raise ValueError(f"a window has more than {MOST_FRAMES} frames")
    while True:
        try:
            out = []
            for at in range(0, len(windows), batch):
                part = windows[at : at + batch]
                padded = np.full((len(part), part[0].shape[0], max(w.shape[1] for w in part)), fill, np.float32)
                for row, w in zip(padded, part):
                    row[:, : w.shape[1]] = w
                got = np.asarray(model(padded), np.float32)
                if got.ndim != 2 or len(got) != len(part):
                    raise ValueError(f"the model gave scores of shape {got.shape} for {len(part)} windows")
                out.append(got)
            return (np.concatenate(out) if out else np.zeros((0, 0), np.float32)), batch
        except Exception as error:
            if batch == 1 or not is_memory_pressure(error):
                raise
        batch = max(1, batch // 2)


def window_scores(windows: DataFrame, load: Callable[[], Model], batch: int = 32, fill: float = 0.0) -> DataFrame:
    """(video_id, w, class_index, score) of windows (video_id, w, bands, features: bands times frames numbers, band by band).

    load is called once by each task and gives its model, a function from (windows, bands, frames) to (windows, classes). A
    task goes on with the batch size that its memory allowed. A window without features has no scores.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, size = load(), batch
        for pdf in parts:
            pdf = pdf[[x is not None and len(x) > 0 for x in pdf["features"]]]
            shaped = [np.asarray(x, np.float32).reshape(int(bands), -1) for x, bands in zip(pdf["features"], pdf["bands"])]
            if not shaped:
                continue
            got, size = scored(model, shaped, size, fill)
            classes = got.shape[1]
            yield pd.DataFrame({"video_id": np.repeat(pdf["video_id"].to_numpy(), classes), "w": np.repeat(pdf["w"].to_numpy(), classes), "class_index": np.tile(np.arange(classes, dtype=np.int32), len(got)), "score": got.ravel()})

    return windows.select("video_id", "w", "bands", "features").mapInPandas(run, schemas.WINDOW_SCORES)
