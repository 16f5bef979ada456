"""The stateful tracker: detections of a stream, frame by frame, become segments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from cuelattice.operators.smoothing import smooth_series
from cuelattice.sources.storage import ship_package

FLOOR = 0.3  # similarity below which overlapping boxes hold different texts


@dataclass(frozen=True)
class Settings:
    """Thresholds of the tracker."""

    min_iou: float = 0.5
    min_similarity: float = 0.7
    near: float = 0.10  # share of the frame's diagonal
    diagonal: float = math.hypot(1920, 1080)
    stride: int = 1
    inactive: float = 3
    max_active: int = 100

    @property
    def patience(self) -> int:
        """Frames that a segment may go without a match."""
        return max(3, math.ceil(self.inactive * self.stride))


@dataclass
class Segment:
    """One text that is being followed."""

    number: int
    canonical: str
    entries: list[tuple] = field(default_factory=list)  # frame, time, (x, y, width, height), text

    @property
    def first(self) -> int:
        return self.entries[0][0]

    @property
    def last(self) -> int:
        return self.entries[-1][0]


def overlap(a: tuple, b: tuple) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


def edit_distance(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def likeness(a: str, b: str) -> float:
    a, b = a.strip(), b.strip()
    return 1.0 if not a and not b else 1 - edit_distance(a, b) / max(len(a), len(b))


def likeness_at_most(a: str, b: str) -> float:
    """A bound of the likeness from the lengths alone."""
    m, n = len(a.strip()), len(b.strip())
    return 1 - abs(m - n) / max(m, n, 1)


class Tracker:
    """State of one stream. observe() takes the frames in order and gives the segments that end."""

    def __init__(self, settings: Settings) -> None:
        self.settings, self.active, self.count = settings, [], 0

    def _pairs(self, frame: int, regions: list[tuple]) -> list[tuple[float, int, Segment]]:
        s, found = self.settings, []
        for i, (_, box, text) in enumerate(regions):
            for segment in self.active:
                if frame - segment.last > s.patience:
                    continue
                _, _, old, was = segment.entries[-1]
                over = overlap(box, old)
                apart = math.hypot(box[0] + box[2] / 2 - old[0] - old[2] / 2, box[1] + box[3] / 2 - old[1] - old[3] / 2)
                least = min([FLOOR] * (over >= s.min_iou) + [s.min_similarity] * (apart <= s.near * s.diagonal), default=2.0)
                if likeness_at_most(text, was) < least:
                    continue  # too far apart, or of too different lengths, whatever the texts are
                like = likeness(text, was)
                if like >= least:
                    found.append((over + like - apart / s.diagonal, i, segment))
        return sorted(found, key=lambda f: -f[0])

    def observe(self, frame: int, regions: list[tuple]) -> list[Segment]:
        """regions: (time, box, text) of the frame. Best pairs first, each region and segment once."""
        regions = [r for r in regions if r[2].strip()]
        taken: dict[int, Segment] = {}
        used: set[int] = set()
        for _, i, segment in self._pairs(frame, regions):
            if i not in taken and segment.number not in used:
                taken[i] = segment
                used.add(segment.number)
        for i, (time, box, text) in enumerate(regions):
            segment = taken.get(i)
            if segment is None:
                self.count += 1
                segment = Segment(self.count, text)
                self.active.append(segment)
            elif len(text.strip()) > len(segment.canonical.strip()):
                segment.canonical = text
            segment.entries.append((frame, time, box, text))
        ended = [x for x in self.active if frame - x.last > self.settings.patience]
        self.active = [x for x in self.active if frame - x.last <= self.settings.patience]
        if len(self.active) > self.settings.max_active:
            self.active.sort(key=lambda x: x.first)
            over = len(self.active) - self.settings.max_active
            ended += self.active[:over]
            self.active = self.active[over:]
        return ended

    def finish(self) -> list[Segment]:
        ended, self.active = self.active, []
        return ended


def dense(entries: list[tuple]) -> list[tuple]:
    """Entries with the frames between them interpolated: frame, time, box, text, interpolated."""
    out = []
    for (f, t, box, text), after in zip(entries, entries[1:] + [None], strict=True):
        out.append((f, t, box, text, False))
        if after:
            for g in range(f + 1, after[0]):
                s = (g - f) / (after[0] - f)
                mid = tuple(round(a + (b - a) * s) for a, b in zip(box, after[2], strict=True))
                out.append((g, t + (after[1] - t) * s, (*mid[:2], max(1, mid[2]), max(1, mid[3])), after[3] if len(after[3]) > len(text) else text, True))
    return out


COLUMNS = "stream_id long, segment_id string, frame_index int, t double, x int, y int, width int, height int, text string, interpolated boolean, canonical_text string"


def entries_of(stream: int, segment: Segment, smooth: bool) -> Iterator[tuple]:
    """Rows of a segment that has ended, gaps filled and, if wanted, boxes smoothed."""
    rows = dense(segment.entries)
    boxes = [r[2] for r in rows]
    if smooth:
        boxes = smooth_series([r[0] for r in rows], boxes)
    for (frame, time, _, text, made), box in zip(rows, boxes, strict=True):
        yield (stream, f"seg-{segment.number:06d}", frame, time, *box, text, made, segment.canonical)


def track(detections: DataFrame, settings: Settings = Settings(), smooth: bool = True) -> DataFrame:
    """Entries of all segments of detections(stream_id, frame_index, t, box, text).

    A stream is tracked in one task, since each frame depends on the one before; streams
    are independent. Streams are sorted within partitions and tracked as they go by: a
    task holds a batch, the open segments and those that end, not a stream. Frames without
    detections need no rows: patience counts frames. Regions of one frame come in the order
    of the column place, if there is one, then of box and text.
    """
    ship_package(detections.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    place = ["place"] if "place" in detections.columns else []
    order = ["stream_id", "frame_index", *place, "x", "y", "width", "height", "text"]
    flat = detections.select("stream_id", "frame_index", "t", "box.x", "box.y", "box.width", "box.height", "text", *place)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, now, regions = Tracker(settings), (None, None), []

        def rows_of(ended: list[Segment]) -> list[tuple]:
            return [r for s in ended for r in entries_of(now[0], s, smooth)]

        for part in parts:
            out = []
            for stream, frame, t, x, y, w, h, text in part[["stream_id", "frame_index", "t", "x", "y", "width", "height", "text"]].itertuples(index=False):
                if (stream, frame) != now:
                    out += rows_of(tracker.observe(int(now[1]), regions)) if regions else []
                    regions = []
                    if stream != now[0]:
                        out += rows_of(tracker.finish())
                        tracker = Tracker(settings)
                    now = (stream, frame)
                regions.append((t, (int(x), int(y), int(w), int(h)), text or ""))
            if out:
                yield pd.DataFrame(out, columns=names)
        if regions:
            out = rows_of(tracker.observe(int(now[1]), regions)) + rows_of(tracker.finish())
            yield pd.DataFrame(out, columns=names)

    return flat.repartition("stream_id").sortWithinPartitions(*order).mapInPandas(run, COLUMNS)
