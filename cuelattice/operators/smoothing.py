"""The One-Euro filter: a low-pass filter whose cutoff rises with speed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.sources.storage import ship_package

MIN_CUTOFF, BETA, D_CUTOFF, STEADY = 0.3, 0.5, 1.0, 0.3


def one_euro(frames: list[int], values: list[float], min_cutoff: float = MIN_CUTOFF, beta: float = BETA, d_cutoff: float = D_CUTOFF) -> list[float]:
    """Values filtered in the order given; steps are distances of frames, 1 at least."""

    def alpha(cutoff: float, step: float) -> float:
        return 1 / (1 + 1 / (2 * math.pi * cutoff) / step)

    out, slope = [float(values[0])], 0.0
    for before, now, raw in zip(frames, frames[1:], values[1:], strict=False):
        step = abs(now - before) or 1
        a = alpha(d_cutoff, step)
        slope = a * (raw - out[-1]) / step + (1 - a) * slope
        a = alpha(min_cutoff + beta * abs(slope), step)
        out.append(a * raw + (1 - a) * out[-1])
    return out


def both_ways(frames: list[int], values: list[float], **settings: float) -> list[float]:
    """Mean of the filter run forwards and backwards, which has no lag."""
    ahead = one_euro(frames, values, **settings)
    back = one_euro(frames[::-1], values[::-1], **settings)[::-1]
    return [(a + b) / 2 for a, b in zip(ahead, back, strict=True)]


def smooth_series(frames: list[int], boxes: list[tuple], **settings: float) -> list[tuple]:
    """Boxes of one segment filtered twice both ways, each number by itself.

    Sizes that vary little are set to their upper median. One box alone stays as it is.
    """
    if len(boxes) < 2:
        return boxes
    series = []
    for i in range(4):
        values = [float(b[i]) for b in boxes]
        for _ in range(2):
            values = both_ways(frames, values, **settings)
        if i >= 2:
            middle = sorted(values)[len(values) // 2]
            if max(values) - min(values) < STEADY * middle:
                values = [middle] * len(values)
        series.append([max(int(i >= 2), round(v)) for v in values])
    return list(zip(*series, strict=True))


Smoother = Callable[[list[int], list[tuple]], list[tuple]]


def lock_series(frames: list[int], boxes: list[tuple], lock: int, alpha: float) -> list[tuple]:
    """Boxes of one segment held while all four numbers stay within lock, else averaged.

    The state keeps the average unrounded; each box is rounded half to even, the first too.
    """
    at, out = [float(v) for v in boxes[0]], []
    for box in boxes:
        if any(abs(v - a) > lock for v, a in zip(box, at, strict=True)):
            at = [alpha * v + (1 - alpha) * a for v, a in zip(box, at, strict=True)]
        out.append(tuple(max(int(i >= 2), round(a)) for i, a in enumerate(at)))
    return out


def by_segment(entries: DataFrame, keys: list[str], smooth: Smoother) -> DataFrame:
    """Entries (keys, frame_index, box) with the boxes that a function makes of each segment's, in order.

    Segments are sorted within partitions and smoothed as they stream by, so that many
    short ones cost no call each; a task holds a batch and one segment. All columns stay.
    """
    ship_package(entries.sparkSession)
    names = ["x", "y", "width", "height"]
    flat = entries.select(*[c for c in entries.columns if c != "box"], *[F.col(f"box.{c}").alias(f"_{c}") for c in names])
    place = [f"_{c}" for c in names]

    def apply(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        frames, boxes, out = rows["frame_index"].tolist(), rows[place].to_numpy().tolist(), []
        for a, b in zip(first, [*first[1:], len(rows)], strict=True):
            out += smooth(frames[a:b], [tuple(x) for x in boxes[a:b]])
        return rows.assign(**dict(zip(place, np.array(out, np.int32).reshape(-1, 4).T, strict=True)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in parts:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            same = (rows[keys] == rows[keys].shift()).all(axis=1).to_numpy()
            first = np.flatnonzero(~same)
            if len(first) > 1:
                yield apply(rows.iloc[: first[-1]], first[:-1])
            held = rows.iloc[first[-1] :].reset_index(drop=True) if len(first) else None
        if held is not None and len(held):
            yield apply(held, np.array([0]))

    out = flat.repartition(*keys).sortWithinPartitions(*keys, "frame_index").mapInPandas(run, flat.schema)
    box = F.struct(*[F.col(f"_{c}").alias(c) for c in names]).alias("box")
    return out.select(*[box if c == "box" else F.col(c) for c in entries.columns])


def smooth_one_euro(entries: DataFrame, keys: list[str], **settings: float) -> DataFrame:
    """Entries (keys, frame_index, box, …) with boxes smoothed by smooth_series, segment by segment."""
    return by_segment(entries, keys, lambda frames, boxes: smooth_series(frames, boxes, **settings))


def smooth_locked(entries: DataFrame, keys: list[str], lock: int, alpha: float) -> DataFrame:
    """Entries (keys, frame_index, box, …) with boxes smoothed by lock_series, segment by segment."""
    return by_segment(entries, keys, lambda frames, boxes: lock_series(frames, boxes, lock, alpha))
