"""Every query of the engine's own operators against its SQL, and those without SQL against one another."""

import math
import os

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from cuelattice.operators import tracking
from cuelattice.plans import queries
from cuelattice.plans.queries import QUERIES, SQL
from cuelattice.sources import views
from cuelattice.streaming.streams import ProgressLog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    v = float(v)
    return None if math.isnan(v) else round(v, 6) + 0.0


def key(row):
    return tuple((v is not None, isinstance(v, str), str(v) if isinstance(v, str) else float(v or 0)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = [tuple(plain(r[c]) for c in names) for r in frame.collect()]
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = [tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names) for r in found.fetchall()]
    assert got and sorted(got, key=key) == sorted(want, key=key)


def test_streamed_tracker_agrees_with_the_batch(spark):
    log = ProgressLog()
    spark.streams.addListener(log)
    batch, stream = ({tuple(r) for r in QUERIES[n](spark, SF).collect()} for n in ("segment_track", "stream_track"))
    spark.streams.removeListener(log)
    assert batch and batch == stream
    assert ("start", 0, 0) in log.events


BRUTE = ("segment_track", "stream_track", "track_regions", "segment_one_euro", "layout_plan", "layout_plan_fixed")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - set(BRUTE)))
def test_query_without_sql_runs_and_repeats(spark, name):
    first, second = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == second


def distance(a, b):
    """Edit distance by the whole table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def segments_by_hand(rows, s):
    """rows: (frame, time, box, text) of a stream, in order. Segments as lists of these, in the order in which they open."""
    made, open_ = [], []
    for frame in sorted({r[0] for r in rows}):
        new = [r for r in rows if r[0] == frame]
        scores = {}
        for i, (_, _, b, text) in enumerate(new):
            for k in open_:
                f, _, o, was = made[k][-1]
                w, h = min(b[0] + b[2], o[0] + o[2]) - max(b[0], o[0]), min(b[1] + b[3], o[1] + o[3]) - max(b[1], o[1])
                iou = w * h / (b[2] * b[3] + o[2] * o[3] - w * h) if w > 0 and h > 0 else 0.0
                like = 1 - distance(text, was) / max(len(text), len(was))
                far = math.hypot(b[0] + b[2] / 2 - o[0] - o[2] / 2, b[1] + b[3] / 2 - o[1] - o[3] / 2)
                if frame - f <= s.patience and ((iou >= s.min_iou and like >= 0.3) or (like >= s.min_similarity and far <= s.near * s.diagonal)):
                    scores[i, k] = iou + like - far / s.diagonal
        pairs = {}
        while scores:
            i, k = max(scores, key=lambda p: (scores[p], -p[0], -open_.index(p[1])))
            pairs[i] = k
            scores = {p: v for p, v in scores.items() if p[0] != i and p[1] != k}
        for i, r in enumerate(new):
            if i not in pairs:
                made.append([])
                open_.append(len(made) - 1)
            made[pairs.get(i, len(made) - 1)].append(r)
        open_ = [k for k in open_ if frame - made[k][-1][0] <= s.patience]
        if len(open_) > s.max_active:
            open_ = sorted(open_, key=lambda k: made[k][0][0])[len(open_) - s.max_active :]
    return made


@pytest.mark.parametrize(("name", "view", "least", "settings"), [("segment_track", views.detections, 0.5, tracking.Settings()), ("track_regions", views.regions, 0.1, queries.TRACKED)])
def test_tracking_agrees_with_brute_force(spark, name, view, least, settings):
    found = view(spark, SF).where(F.col("confidence") >= least)
    place = [c for c in ("place",) if c in found.columns]
    streams_ = {}
    for r in found.orderBy("stream_id", "frame_index", *place, "box.x", "box.y", "box.width", "box.height", "text").collect():
        streams_.setdefault(r.stream_id, []).append((r.frame_index, r.t, tuple(r.box), r.text))
    want = {(stream, frozenset((f, b if name == "track_regions" else None, text) for f, _, b, text in seg)) for stream, rows in streams_.items() for seg in segments_by_hand(rows, settings)}
    got = {}
    for r in QUERIES[name](spark, SF).where("NOT interpolated").collect():
        got.setdefault((r.stream_id, r.segment_id), set()).add((r.frame_index, (r.x, r.y, r.width, r.height) if name == "track_regions" else None, r.text))
    assert {(k[0], frozenset(v)) for k, v in got.items()} == want
    if name == "track_regions":
        assert max(map(len, streams_.values())) > 10 and len(want) > 2 * len(streams_)


def test_one_euro_agrees_with_brute_force(spark):
    """The filter written out step by step, forwards and backwards, twice, on every segment of the table."""
    def once(frames, xs):
        x, slope, out = xs[0], 0.0, [xs[0]]
        for i in range(1, len(xs)):
            dt = abs(frames[i] - frames[i - 1]) or 1
            weight = lambda cutoff, dt=dt: dt / (dt + 1 / (2 * math.pi * cutoff))
            slope += weight(1.0) * ((xs[i] - x) / dt - slope)
            x += weight(0.3 + 0.5 * abs(slope)) * (xs[i] - x)
            out.append(x)
        return out

    parts = {}
    for r in queries.observed(spark, SF).orderBy("frame_index").collect():
        parts.setdefault((r.stream_id, r.text, r.island), []).append((r.frame_index, *r.box))
    want = []
    for key_, rows in parts.items():
        frames, columns = [r[0] for r in rows], [[float(v) for v in c] for c in list(zip(*rows, strict=True))[1:]]
        for i in range(4 if len(rows) > 1 else 0):
            for _ in range(2):
                ahead, back = once(frames, columns[i]), once(frames[::-1], columns[i][::-1])[::-1]
                columns[i] = [(a + b) / 2 for a, b in zip(ahead, back, strict=True)]
            middle = sorted(columns[i])[len(rows) // 2]
            if i >= 2 and max(columns[i]) - min(columns[i]) < 0.3 * middle:
                columns[i] = [middle] * len(rows)
        want += [(*key_, f, *(max(int(i >= 2), round(c)) for i, c in enumerate(cs))) for f, *cs in zip(frames, *columns, strict=True)]
    got = [(r.stream_id, r.text, r.island, r.frame_index, r.x, r.y, r.width, r.height) for r in QUERIES["segment_one_euro"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_layout_agrees_with_brute_force(spark):
    """All sizes tried one by one, for each way in turn."""
    def fits(lines, size, w, h, narrow):
        return math.ceil(max(map(len, lines)) * size * (0.6 * narrow)) <= w and math.ceil(size * 1.2) * len(lines) <= h

    def wrapped(text, n):
        words, goal, lines = text.split(), max(1, len(text) // n), [""]
        for word in words:
            if lines[-1] and len(lines[-1]) + 1 + len(word) > goal and len(lines) < n:
                lines.append(word)
            else:
                lines[-1] = f"{lines[-1]} {word}".strip()
        return lines if len(words) >= n and len(lines) == n else None

    def grown(x, y, w, h):
        nw, nh = round(w * 1.5), round(h * 1.3)
        nx, ny = round(x + w / 2 - nw / 2), round(y + h / 2 - nh / 2)
        a, b, c, d = max(0, nx), max(0, ny), min(1920, nx + nw), min(1080, ny + nh)
        return (a, b, c - a, d - b) if c - a > w or d - b > h else None

    def forced(x, y, w, h, need_w, need_h):
        nw, nh = max(w, need_w), max(h, need_h)
        nx, ny = round(x + w / 2 - nw / 2), round(y + h / 2 - nh / 2)
        a, b, c, d = max(0, nx), max(0, ny), min(1920, nx + nw), min(1080, ny + nh)
        return (a, b, c - a, d - b) if c > a and d > b else None

    def cascade(text, own, sizes):
        for narrow in (1.0, 0.8):
            for box in (own, grown(*own)):
                size = max((z for z in sizes if box and fits([text], z, box[2], box[3], narrow)), default=None)
                if size:
                    return (*box, narrow != 1, size, text)
            for box in (own, grown(*own)):
                best = None
                for n in (2, 3):
                    lines = wrapped(text, n)
                    size = max((z for z in sizes if box and lines and fits(lines, z, box[2], box[3], narrow)), default=None)
                    if size and best and size <= best[5]:
                        break
                    if size:
                        best = (*box, narrow != 1, size, "\n".join(lines))
                if best:
                    return best
        return None

    def at_size(text, own, size):
        found = cascade(text, own, [size])
        for n in (1, 2, 3):
            lines = [text] if n == 1 else wrapped(text, n)
            if found is None and lines:
                need = (math.ceil(max(map(len, lines)) * size * 0.6), math.ceil(size * 1.2) * n)
                box = forced(*own, *need)
                if box and need[0] <= box[2] and need[1] <= box[3]:
                    found = (*box, False, size, "\n".join(lines))
        return found or cascade(text, own, range(12, 49))

    ways = {name: {r.p_partkey: tuple(r)[1:] for r in QUERIES[name](spark, SF).collect()} for name in ("layout_plan", "layout_plan_fixed")}
    kinds = set()
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        own = (r.p_partkey % 1500, r.p_partkey % 900, 60 + r.p_size * 4, 16 + r.p_size % 40)
        for name, want in (("layout_plan", cascade(r.p_name, own, range(12, 49))), ("layout_plan_fixed", at_size(r.p_name, own, 12 + r.p_partkey % 70))):
            assert ways[name][r.p_partkey] == (want or (None,) * 7)
            kinds.add((name, want and (want[4], want[:4] == own, "\n" in want[6])))
    assert len(kinds) >= 6


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
