"""One query for each operator over the given tables, with the SQL that must agree with it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelattice.functions import geometry as G
from cuelattice.functions import numeric as N
from cuelattice.functions import text as X
from cuelattice.operators import audio, detections, enrichment, layout, picture, scenes, schedules, segments, subtitles, timeline, tracking
from cuelattice.operators.smoothing import smooth_locked, smooth_one_euro
from cuelattice.plans import config
from cuelattice.sources import storage, views
from cuelattice.sources.views import FRAME_HEIGHT as H
from cuelattice.sources.views import FRAME_WIDTH as W
from cuelattice.sources.views import table
from cuelattice.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIAGONAL = math.hypot(W, H)
GAP = 3 * 86400.0  # seconds without a detection after which a segment ends
LATIN = ((0xC0, 0xFF),)  # the given tables have no CJK text, so this range stands for it
STEP, WINDOW, FPS = 10.0, 2.0, 30.0

_FRAMES = """frames AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS frame_index,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::double AS t, event_id, event_type, value
  FROM events)"""
_DET = f"""{_FRAMES}, det AS (
  SELECT stream_id, frame_index, t, event_id, event_type AS text, (event_id * 37 % 1000) / 1000.0::double AS confidence,
    event_id * 13 % 1600 AS x, event_id * 7 % 900 AS y, 20 + event_id % 200 AS w, 10 + event_id % 60 AS h
  FROM frames)"""
_OBS = f"""{_DET}, obs AS (SELECT * FROM det WHERE confidence >= 0.5), marked AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY stream_id, text ORDER BY t, event_id) <= {GAP} THEN 0 ELSE 1 END AS opens FROM obs), isl AS (
  SELECT *, sum(opens) OVER (PARTITION BY stream_id, text ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM marked)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has any."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def flat(b: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{b}.{c}").alias(prefix + c) for c in ("x", "y", "width", "height")]


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of enough confidence, numbered by island."""
    rows = detections.usable(views.detections(spark, sf_dir), 0.5, None)
    return segments.islands(rows, ["stream_id", "text"], "t", GAP, "event_id")


KEYS = ["stream_id", "text", "island"]


# Detections.


@query(f"WITH {_DET} SELECT stream_id, frame_index, event_id, confidence FROM det WHERE confidence >= 0.5 AND w > 0 AND h > 0 AND length(text) > 0")
def det_confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.usable(views.detections(spark, sf_dir), 0.5, None).select("stream_id", "frame_index", "event_id", "confidence")


@query(f"WITH {_FRAMES} SELECT stream_id, frame_index, event_id FROM (SELECT *, count(*) OVER (PARTITION BY stream_id) AS n FROM frames) f WHERE frame_index % 3 = 0 OR frame_index = n - 1")
def det_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.stride(views.frames(spark, sf_dir), 3).select("stream_id", "frame_index", "event_id")


@query(
    f"""WITH {_DET}, p AS (SELECT event_id, confidence, greatest(0, round_even(x * 1.5::double, 0)) AS x1, greatest(0, round_even(y * 1.5::double, 0)) AS y1,
      least({W}, round_even((x + w) * 1.5::double, 0)) AS x2, least({H}, round_even((y + h) * 1.5::double, 0)) AS y2 FROM det)
    SELECT event_id, confidence, x1::int AS x, y1::int AS y, (x2 - x1)::int AS width, (y2 - y1)::int AS height FROM p WHERE x2 > x1 AND y2 > y1 AND confidence >= 0.25"""
)
def det_poly_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = views.detections(spark, sf_dir)
    b = F.col("box")

    def point(x: Column, y: Column) -> Column:
        return F.array(x.cast("double"), y.cast("double"))

    poly = F.array(point(b["x"], b["y"]), point(G.right(b), b["y"]), point(G.right(b), G.bottom(b)), point(b["x"], G.bottom(b)))
    raw = det.select("event_id", F.array("text").alias("texts"), F.array(F.col("confidence").cast("string")).alias("scores"), F.array(poly).alias("polys"))
    out = detections.unpack(raw, 1.5, 1.5, W, H, 0.25, ((0x20, 0x7E),))
    return out.select("event_id", "confidence", *flat("box"))


@query(
    f"""SELECT p_partkey, greatest(1, round_even(p_size * 40 / 1.5::double, 0))::int AS width, greatest(1, round_even(p_size * 30 / 1.5::double, 0))::int AS height,
      round(p_size * 40 / greatest(1, round_even(p_size * 40 / 1.5::double, 0)), 6) AS scale_x FROM part"""
)
def det_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    out = part.select("p_partkey", G.downscaled(F.col("p_size") * 40, F.col("p_size") * 30, 1.5).alias("d"))
    return out.select("p_partkey", "d.width", "d.height", r6("d.scale_x").alias("scale_x"))


# Text.


@query("SELECT doc_id, regexp_matches(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]') AS cjk, regexp_matches(text, '[\\x{00C0}-\\x{00FF}]') AS latin FROM documents")
def text_script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.has_script(text).alias("cjk"), X.has_script(text, LATIN).alias("latin"))


@query(r"SELECT conv_id, turn, length(regexp_replace(text, '^[\s\x{3000}\x{00A0}]+|[\s\x{3000}\x{00A0}]+$', '', 'g')) AS n FROM (SELECT conv_id, turn, ' ' || text || chr(10) AS text FROM conversations) c")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" "), F.col("text"), F.lit("\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(X.normalize(padded)).cast("long").alias("n"))


@query(
    """WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
    SELECT p_partkey, levenshtein(a, b) AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::double, 6) AS similarity FROM p WHERE b IS NOT NULL"""
)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), after.alias("b")).where("b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return part.select("p_partkey", F.levenshtein(a, b).cast("long").alias("distance"), r6(X.similarity(a, b)).alias("similarity"))


@query("SELECT p_brand, arg_max(p_name, length(p_name) * 10000000 - p_partkey) AS canonical FROM part GROUP BY p_brand")
def text_canonical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(X.canonical(F.col("p_name"), F.col("p_partkey")).alias("canonical"))


def _wrapped(n: int) -> str:
    """The lines of p_name dealt to n lines, by a fold over its words."""
    return f"""(SELECT CASE WHEN len(ws) >= {n} AND len(list_append(r.done, r.line)) = {n} THEN array_to_string(list_append(r.done, r.line), chr(10)) END FROM (SELECT ws, list_reduce(list_transform(ws, lambda w: {{'done': []::varchar[], 'line': w}}), lambda a, v:
      CASE WHEN length(a.line) + 1 + length(v.line) > greatest(1, length(p_name) // {n}) AND len(a.done) < {n} - 1 THEN {{'done': list_append(a.done, a.line), 'line': v.line}} ELSE {{'done': a.done, 'line': a.line || ' ' || v.line}} END) AS r
      FROM (SELECT list_filter(regexp_split_to_array(p_name, '\\s+'), lambda w: w <> '') AS ws) x) y)"""


@query(f"SELECT p_partkey, {_wrapped(2)} AS lines_2, {_wrapped(3)} AS lines_3 FROM part")
def text_wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", *[F.array_join(X.wrap_lines(F.col("p_name"), n), "\n").alias(f"lines_{n}") for n in (2, 3)])


@query(
    """WITH m AS (SELECT o_orderkey, round_even(greatest(o_totalprice / 7 - 1000, 0) * 1000, 0)::bigint AS ms FROM orders)
    SELECT o_orderkey, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS ts FROM m"""
)
def srt_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.srt_timestamp(F.col("o_totalprice") / 7 - 1000).alias("ts"))


_BATCHED = """d AS (SELECT p_brand AS norm_text, min(p_partkey) AS ord FROM part GROUP BY p_brand),
    b AS (SELECT norm_text, (row_number() OVER (ORDER BY ord, norm_text) - 1) // 4 AS batch, (row_number() OVER (ORDER BY ord, norm_text) - 1) % 4 AS place FROM d)"""


@query(f"WITH {_BATCHED} SELECT batch, count(*)::int AS n, 'Each line apart.' || chr(10) || 'At most 40 characters for each.' || chr(10) || string_agg((place + 1)::varchar || '. ' || norm_text, chr(10) ORDER BY place) AS prompt FROM b GROUP BY batch")
def batch_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = enrichment.distinct_texts(table(spark, sf_dir, "part"), "p_brand", "p_partkey")
    return enrichment.prompts(enrichment.batches(texts, 4), "Each line apart.\n", 40)


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS first, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS second FROM part"""
)
def batch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat(F.lit('1. "'), F.col("p_name"), F.lit('"\n\n 2.  '), F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, "\n3. more").otherwise("\n"))
    items = X.parse_numbered(lines, F.lit(2))
    return table(spark, sf_dir, "part").select("p_partkey", items[0].alias("first"), items[1].alias("second"))


# Boxes.

_PAIR = f"""{_DET}, pair AS (
  SELECT a.stream_id, a.event_id AS a_id, b.event_id AS b_id, a.text AS a_text, b.text AS b_text,
    least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ow, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oh, a.w * a.h + b.w * b.h AS both_areas,
    sqrt(power(a.x + a.w / 2.0::double - b.x - b.w / 2.0::double, 2) + power(a.y + a.h / 2.0::double - b.y - b.h / 2.0::double, 2)) AS distance
  FROM det a JOIN det b ON a.stream_id = b.stream_id AND b.frame_index = a.frame_index + 1), m AS (
  SELECT *, CASE WHEN ow > 0 AND oh > 0 THEN ow * oh / (both_areas - ow * oh)::double ELSE 0 END AS iou,
    1 - levenshtein(a_text, b_text) / greatest(length(a_text), length(b_text))::double AS similarity FROM pair)"""


@query(
    f"""WITH {_PAIR} SELECT stream_id, a_id, b_id, round(iou, 6) AS iou, round(similarity, 6) AS similarity, round(distance, 4) AS distance, round(iou + similarity - distance / {DIAGONAL}, 6) AS score
    FROM m WHERE (iou >= 0.05 AND similarity >= 0.3) OR (similarity >= 0.7 AND distance <= 0.1 * {DIAGONAL})"""
)
def box_iou_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detections.adjacent_matches(views.detections(spark, sf_dir), 0.05, 0.7, 0.1, DIAGONAL)
    return out.select("stream_id", "a_id", "b_id", r6("iou").alias("iou"), r6("similarity").alias("similarity"), F.round("distance", 4).alias("distance"), r6("score").alias("score"))


@query(
    f"""WITH {_DET}, e AS (SELECT *, round_even(w * 1.5::double, 0) AS nw, round_even(h * 1.25::double, 0) AS nh FROM det), f AS (
      SELECT *, round_even(x + w / 2.0::double - nw / 2.0::double, 0) AS nx, round_even(y + h / 2.0::double - nh / 2.0::double, 0) AS ny FROM e), g AS (
      SELECT *, greatest(0, nx) AS x1, greatest(0, ny) AS y1, least(1600, nx + nw) AS x2, least(900, ny + nh) AS y2,
        greatest(0, x) AS cx1, greatest(0, y) AS cy1, least(1600, x + w) AS cx2, least(900, y + h) AS cy2 FROM f)
    SELECT event_id, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN ((cx2 - cx1) * (cy2 - cy1))::bigint END AS clip_area,
      greatest(1, round_even(w * 0.55::double, 0))::int AS scaled_width, CASE WHEN x2 - x1 > w OR y2 - y1 > h THEN x1::int END AS grown_x, CASE WHEN x2 - x1 > w OR y2 - y1 > h THEN (x2 - x1)::int END AS grown_width,
      CASE WHEN x2 - x1 > w OR y2 - y1 > h THEN (y2 - y1)::int END AS grown_height FROM g"""
)
def box_clip_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    out = views.detections(spark, sf_dir).select("event_id", G.clip(b, 1600, 900).alias("c"), G.scale(b, 0.55).alias("s"), G.expand(b, 1.5, 1.25, 1600, 900).alias("g"))
    return out.select("event_id", G.area(F.col("c")).alias("clip_area"), F.col("s.width").alias("scaled_width"), F.col("g.x").alias("grown_x"), F.col("g.width").alias("grown_width"), F.col("g.height").alias("grown_height"))


@query(
    f"""WITH {_DET}, p AS (SELECT stream_id, greatest(0, x - 4) AS x1, greatest(0, y - 4) AS y1, least({W}, x + w + 4) AS x2, least({H}, y + h + 4) AS y2 FROM det), c AS (
      SELECT stream_id, unnest(generate_series(x1 // 64, (x2 - 1) // 64)) AS cx, y1, y2 FROM p), d AS (SELECT stream_id, cx, unnest(generate_series(y1 // 64, (y2 - 1) // 64)) AS cy FROM c)
    SELECT stream_id, count(*) AS cells FROM (SELECT DISTINCT stream_id, cx, cy FROM d) e GROUP BY stream_id"""
)
def box_mask_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.coverage(views.detections(spark, sf_dir), 64, 4, W, H).groupBy("stream_id").agg(F.count("*").alias("cells"))


@query(
    f"""WITH {_OBS}, f AS (SELECT stream_id, text, island, arg_min(x + w / 2.0::double, frame_index) AS cx, arg_min(y + h / 2.0::double, frame_index) AS cy FROM isl GROUP BY stream_id, text, island)
    SELECT stream_id, text, island::bigint AS island FROM f WHERE cx BETWEEN 200 AND 1000 AND cy BETWEEN 100 AND 700"""
)
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("frame_index", "box"))).alias("entries")
    made = observed(spark, sf_dir).groupBy(*KEYS).agg(entries)
    return segments.in_region(made, G.box(F.lit(200), F.lit(100), F.lit(800), F.lit(600))).select("stream_id", "text", F.col("island").cast("long"))


@query(
    f"""WITH {_DET}, s AS (SELECT event_id, greatest(0, least(trunc((x - 50) / 0.5::double), {W}))::int AS x1, greatest(0, least(trunc((y - 50) / 0.5::double), {H}))::int AS y1,
      greatest(0, least(trunc((x - 50 + w) / 0.5::double), {W}))::int AS x2, greatest(0, least(trunc((y - 50 + h) / 0.5::double), {H}))::int AS y2 FROM det)
    SELECT event_id, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height FROM s WHERE x2 > x1 AND y2 > y1"""
)
def canvas_to_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    x, y = b["x"] - 50, b["y"] - 50
    out = G.canvas_to_frame(x + b["width"], y, x, y + b["height"], F.lit(0.5), F.lit(W), F.lit(H))
    return views.detections(spark, sf_dir).select("event_id", out.alias("b")).where("b IS NOT NULL").select("event_id", *flat("b"))


@query(
    f"""WITH {_DET}, p AS (SELECT event_id, x, y, w, h, greatest(w, 150) AS fw, greatest(h, 40) AS fh FROM det), q AS (
      SELECT *, greatest(0, round_even(x + w / 2.0::double - fw / 2.0::double, 0)) AS x1, least({W}, round_even(x + w / 2.0::double - fw / 2.0::double, 0) + fw) AS x2 FROM p)
    SELECT event_id, x1::int AS forced_x, (x2 - x1)::int AS forced_width, (120 <= w AND 30 <= h) AS fits FROM q"""
)
def box_force_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    out = views.detections(spark, sf_dir).select("event_id", G.force_expand(b, F.lit(150), F.lit(40), W, H).alias("f"), G.fits(F.lit(120), F.lit(30), b).alias("fits"))
    return out.select("event_id", F.col("f.x").alias("forced_x"), F.col("f.width").alias("forced_width"), "fits")


@query(
    """WITH f AS (SELECT p_partkey, p_size * 40 AS w, p_size * 30 AS h, radians((p_partkey % 100) / 20.0::double) AS a FROM part)
    SELECT p_partkey, least(w, greatest(trunc(w * cos(a) - h * sin(a)), trunc(w * 0.9::double)))::int AS width, least(h, greatest(trunc(h * cos(a) - w * sin(a)), trunc(h * 0.9::double)))::int AS height FROM f"""
)
def rotation_inscribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = G.inscribed_size(F.col("p_size") * 40, F.col("p_size") * 30, (F.col("p_partkey") % 100) / 20.0)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query(
    f"""WITH {_DET}, c AS (SELECT event_id, w, h, x, y, round_even(x + (w - 60) / 2.0::double, 0) AS px, round_even(y + (h - 20) / 2.0::double, 0) AS py FROM det), k AS (
      SELECT *, greatest(x, least(px, x + w - 60)) AS kx, greatest(y, least(py, y + h - 20)) AS ky FROM c)
    SELECT event_id, CASE WHEN abs(kx - px) <= 2 AND abs(ky - py) <= 2 THEN kx::int END AS x, CASE WHEN abs(kx - px) <= 2 AND abs(ky - py) <= 2 THEN ky::int END AS y FROM k"""
)
def box_place_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = G.place_centered(F.lit(60), F.lit(20), F.col("box"))
    return views.detections(spark, sf_dir).select("event_id", at.alias("p")).select("event_id", "p.x", "p.y")


_REGIONS = f"""{_FRAMES}, det AS (
  SELECT stream_id, frame_index // 3 AS frame_index, event_id, event_type || CASE WHEN event_id % 5 = 0 THEN ' now' ELSE '' END AS text, (event_id * 37 % 1000) / 1000.0::double AS confidence,
    frame_index % 3 * 400 + event_id * 13 % 90 AS x, event_id * 7 % 40 + 100 * (event_id % 2) AS y, 150 + event_id % 20 AS w, 40 + event_id % 6 AS h FROM frames)"""


@query(f"WITH {_PAIR.replace(_DET, _REGIONS)} SELECT stream_id, a_id, b_id, round(iou + similarity - distance / {DIAGONAL}, 6) AS score FROM m WHERE (iou >= 0.2 AND similarity >= 0.3) OR (similarity >= 0.7 AND distance <= 0.1 * {DIAGONAL})")
def region_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of several regions to a frame with those of the next: an equi join on frames with the thresholds as a residual."""
    out = detections.adjacent_matches(views.regions(spark, sf_dir), 0.2, 0.7, 0.1, DIAGONAL)
    return out.select("stream_id", "a_id", "b_id", r6("score").alias("score"))


# Segments.


@query(f"""WITH {_OBS} SELECT stream_id, text, island::bigint AS island, min(frame_index) AS start_frame, max(frame_index) AS end_frame, round(min(t), 6) AS start_time, round(max(t), 6) AS end_time, count(*) AS n_entries FROM isl GROUP BY stream_id, text, island""")
def segment_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = segments.summarize(observed(spark, sf_dir), KEYS)
    return made.select("stream_id", "text", F.col("island").cast("long"), F.col("start_frame").cast("long"), F.col("end_frame").cast("long"), r6("start_time").alias("start_time"), r6("end_time").alias("end_time"), "n_entries")


_SESSIONS = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events), m AS (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {int(GAP * 1e6)} THEN 0 ELSE 1 END AS opens FROM e), i AS (
    SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM i GROUP BY user_id, island"""


def _sessions(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


@query(_SESSIONS)
def segment_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(streams.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", f"{int(GAP)} seconds"))


@query(
    f"""WITH {_OBS}, n AS (SELECT *, lead(frame_index) OVER w AS nf, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(w) OVER w AS nw FROM isl WINDOW w AS (PARTITION BY stream_id, text, island ORDER BY frame_index)), g AS (
      SELECT *, unnest(generate_series(frame_index + 1, nf - 1)) AS f FROM n WHERE nf > frame_index + 1)
    SELECT stream_id, text, f AS frame_index, floor((t + (nt - t) * ((f - frame_index) / (nf - frame_index)::double)) * 1000 + 0.2003)::bigint AS ms, round_even(x + (nx - x) * ((f - frame_index) / (nf - frame_index)::double), 0)::int AS x,
      greatest(1, round_even(w + (nw - w) * ((f - frame_index) / (nf - frame_index)::double), 0))::int AS width, true AS interpolated FROM g
    UNION ALL SELECT stream_id, text, frame_index, floor(t * 1000 + 0.2003)::bigint, x::int, w::int, false FROM isl"""
)
def segment_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.fill_gaps(observed(spark, sf_dir).withColumn("label", F.col("text")), ["stream_id", "label", "island"])
    return out.select("stream_id", "text", F.col("frame_index").cast("long"), F.floor(F.col("t") * 1000 + 0.2003).alias("ms"), "box.x", "box.width", "interpolated")


@query(
    f"""WITH {_OBS}, l AS (SELECT stream_id, text, island, list({{'x': x::double, 'w': w::double}} ORDER BY frame_index) AS b FROM isl GROUP BY stream_id, text, island), r AS (
      SELECT stream_id, text, island, list_reduce(b, lambda a, v: CASE WHEN abs(v.x - a.x) <= 300 AND abs(v.w - a.w) <= 300 THEN a ELSE {{'x': 0.3 * v.x + 0.7 * a.x, 'w': 0.3 * v.w + 0.7 * a.w}} END) AS e FROM l)
    SELECT stream_id, text, island::bigint AS island, round_even(e.x, 0)::int AS x, round_even(e.w, 0)::int AS width FROM r"""
)
def segment_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir).withColumn("box", G.box(F.col("box.x"), F.lit(0), F.col("box.width"), F.lit(1)))
    out = smooth_locked(rows.select(*KEYS, "frame_index", "box"), KEYS, 300, 0.3)
    last = out.groupBy(*KEYS).agg(F.max_by("box", "frame_index").alias("b"))
    return last.select("stream_id", "text", F.col("island").cast("long"), "b.x", "b.width")


@query()
def segment_one_euro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = smooth_one_euro(observed(spark, sf_dir).select(*KEYS, "frame_index", "box"), KEYS)
    return out.select(*KEYS, "frame_index", *flat("box"))


@query()
def segment_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track(detections.usable(views.detections(spark, sf_dir), 0.5, None))


TRACKED = tracking.Settings(min_iou=0.3, max_active=4, inactive=2)


@query()
def track_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several regions to a frame that compete for segments, more than may be open at once."""
    return tracking.track(detections.usable(views.regions(spark, sf_dir), 0.1, None), TRACKED, smooth=False)


@query(
    f"""WITH {_OBS}, f AS (SELECT *, first_value(x + w / 2.0::double) OVER s AS cx, first_value(y + h / 2.0::double) OVER s AS cy FROM isl WINDOW s AS (PARTITION BY stream_id, text, island ORDER BY frame_index))
    SELECT stream_id, frame_index, NOT (cx BETWEEN 200 AND 1000 AND cy BETWEEN 100 AND 700) AS rendered FROM f"""
)
def region_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = G.box(F.lit(200), F.lit(100), F.lit(800), F.lit(600))
    return segments.with_suppression(observed(spark, sf_dir), KEYS, region).select("stream_id", "frame_index", "rendered")


@query(
    f"""WITH {_OBS}, q AS (SELECT DISTINCT stream_id, text, island, greatest(0, frame_index + 5 - event_id % 11) AS target FROM isl), pair AS (
      SELECT q.*, i.frame_index AS f, i.t, abs(i.frame_index - target) AS d FROM q JOIN isl i USING (stream_id, text, island)), n AS (
      SELECT stream_id, text, island, target, arg_min(f, d * 1000000 + f) AS observed, max(CASE WHEN f <= target THEN f END) AS fa, min(CASE WHEN f >= target THEN f END) AS fb,
        arg_max(t, CASE WHEN f <= target THEN f END) AS ta, arg_min(t, CASE WHEN f >= target THEN f END) AS tb FROM pair GROUP BY stream_id, text, island, target)
    SELECT stream_id, text, island::bigint AS island, target AS frame_index, observed AS observed_frame, floor(coalesce(ta + (target - fa) / nullif(fb - fa, 0)::double * (tb - ta), ta, tb) * 1000 + 0.2003)::bigint AS ms FROM n"""
)
def nearest_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir)
    targets = rows.select(*KEYS, F.greatest(F.lit(0).cast("long"), F.col("frame_index") + 5 - F.col("event_id") % 11).alias("frame_index")).distinct()
    keyed = [c.withColumnRenamed("text", "label") for c in (targets, rows)]
    out = segments.nearest_observed(keyed[0], keyed[1].withColumn("text", F.col("label")), ["stream_id", "label", "island"])
    return out.select("stream_id", "text", F.col("island").cast("long"), "frame_index", "observed_frame", F.floor(F.col("t") * 1000 + 0.2003).alias("ms"))


@query(f"WITH {_OBS} SELECT count(DISTINCT stream_id || '|' || text || '|' || island) AS n_segments, count(*) AS n_entries, count(DISTINCT stream_id || '|' || frame_index) AS n_frames FROM isl")
def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).agg(
        F.count_distinct(F.struct(*KEYS)).alias("n_segments"), F.count("*").alias("n_entries"), F.count_distinct(F.struct("stream_id", "frame_index")).alias("n_frames")
    )


@query(
    f"""WITH {_OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id, text, island ORDER BY w * h, frame_index) - 1 AS i, row_number() OVER (PARTITION BY stream_id, text, island ORDER BY w) - 1 AS j, count(*) OVER (PARTITION BY stream_id, text, island) AS c,
      row_number() OVER (PARTITION BY stream_id, text, island ORDER BY h) - 1 AS k, max(w) OVER (PARTITION BY stream_id, text, island) - min(w) OVER (PARTITION BY stream_id, text, island) AS dw,
      max(h) OVER (PARTITION BY stream_id, text, island) - min(h) OVER (PARTITION BY stream_id, text, island) AS dh FROM isl)
    SELECT stream_id, text, island::bigint AS island, max(CASE WHEN i = 0 THEN x END)::int AS smallest_x, max(CASE WHEN i = c // 2 THEN x END)::int AS middle_x, max(CASE WHEN j = c // 2 THEN w END)::int AS median_width,
      (max(dw) < 0.3 * max(CASE WHEN j = c // 2 THEN w END) AND max(dh) < 0.3 * max(CASE WHEN k = c // 2 THEN h END)) AS steady FROM n GROUP BY stream_id, text, island"""
)
def segment_median_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.representative_boxes(observed(spark, sf_dir), KEYS)
    return out.select("stream_id", "text", F.col("island").cast("long"), F.col("smallest.x").alias("smallest_x"), F.col("middle.x").alias("middle_x"), "median_width", "steady")


# Enrichment.


def _upper(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type"))).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE upper(p_type) END AS translated_text, CASE WHEN p_partkey % 5 = 0 THEN 'passthrough' ELSE 'translated' END AS status FROM part")
def translate_dedupe_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich(_part_names(spark, sf_dir), "text", "p_partkey", _upper).select("p_partkey", "translated_text", "status")


@query("SELECT CASE WHEN p_partkey % 5 = 0 THEN 'passthrough' WHEN length(p_type) > 12 THEN 'untranslated' ELSE 'translated' END AS status, count(*) AS n FROM part GROUP BY 1")
def translate_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich(_part_names(spark, sf_dir), "text", "p_partkey", _upper, max_chars=12).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' ' WHEN p_type LIKE 'STANDARD%' THEN 'known' WHEN p_type LIKE 'LARGE%' THEN p_type ELSE upper(p_type) END AS translated_text,
      CASE WHEN p_partkey % 5 = 0 THEN 'passthrough' WHEN p_type LIKE 'LARGE%' THEN 'passthrough' ELSE 'translated' END AS status FROM part"""
)
def translate_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the cache has as translated or passed are taken from it; those it has as untranslated are asked for again."""
    kind = F.substring_index("p_type", " ", 1)
    held = table(spark, sf_dir, "part").select("p_type", kind.alias("kind")).distinct().where("kind IN ('STANDARD', 'LARGE', 'SMALL')")
    cache = held.select(
        F.col("p_type").alias("norm_text"),
        F.when(F.col("kind") == "STANDARD", "known").otherwise(F.col("p_type")).alias("translated_text"),
        F.when(F.col("kind") == "STANDARD", "translated").when(F.col("kind") == "LARGE", "passthrough").otherwise("untranslated").alias("status"),
    )
    return enrichment.enrich(_part_names(spark, sf_dir), "text", "p_partkey", _upper, cache=cache).select("p_partkey", "translated_text", "status")


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events)
    SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) > 5 AS throttled FROM e"""
)
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return enrichment.calls_in_window(calls, ["user_id"], "us", 86_400_000_000, 5).select("user_id", "event_id", "in_window", "throttled")


# Subtitles.


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '[^/]\.[^./]*$') THEN regexp_replace(url, '\.[^./]*$', '.srt') ELSE url || '.srt' END AS path FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/clip.v1.mp4' ELSE '/clip' END AS url FROM pages) p")
def srt_sidecar_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/clip.v1.mp4").otherwise("/clip"))
    return table(spark, sf_dir, "pages").select("page_id", X.srt_path(path).alias("path"))


_CUES = f"""{_OBS}, s AS (SELECT stream_id, text, island, min(t) AS a, max(t) AS b, count(*) AS n FROM isl GROUP BY stream_id, text, island), m AS (
    SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY a, text, island) AS cue, round_even(a * 1000, 0)::bigint AS am, round_even(b * 1000, 0)::bigint AS bm FROM s), c AS (
    SELECT stream_id, cue, printf('%02d:%02d:%02d,%03d', am // 3600000, am // 60000 % 60, am // 1000 % 60, am % 1000) AS start_ts, printf('%02d:%02d:%02d,%03d', bm // 3600000, bm // 60000 % 60, bm // 1000 % 60, bm % 1000) AS end_ts, text FROM m)"""


@query(f"WITH {_CUES} SELECT * FROM c")
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: what was on screen when, as numbered cues of each stream."""
    made = segments.summarize(observed(spark, sf_dir), KEYS)
    return subtitles.cues(made, ["stream_id"], ["text", "island"]).withColumn("cue", F.col("cue").cast("long"))


@query(f"WITH {_CUES} SELECT stream_id, string_agg(cue::varchar || chr(10) || start_ts || ' --> ' || end_ts || chr(10) || text, chr(10) || chr(10) ORDER BY cue) || chr(10) AS srt FROM c GROUP BY stream_id")
def srt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.srt(srt_cues(spark, sf_dir), ["stream_id"])


@query(f"WITH {_CUES}, tr AS (SELECT stream_id, cue, start_ts, end_ts, CASE WHEN length(text) % 2 = 0 THEN upper(text) ELSE text END AS text FROM c) SELECT * FROM tr")
def srt_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = segments.summarize(observed(spark, sf_dir), KEYS).withColumn("segment_id", F.concat_ws("/", *KEYS))
    words = made.where("length(text) % 2 = 0").select("segment_id", F.upper("text").alias("translated_text"))
    return subtitles.cues(made, ["stream_id"], ["canonical_text", "island"], words).withColumn("cue", F.col("cue").cast("long"))


@query(f"WITH {_DET} SELECT f.stream_id, f.frame_index, f.event_id, d.event_id IS NOT NULL AS shown, d.w::int AS width FROM frames f LEFT JOIN (SELECT * FROM det WHERE confidence >= 0.5) d ON f.stream_id = d.stream_id AND f.frame_index = d.frame_index")
def frame_entry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = detections.usable(views.detections(spark, sf_dir), 0.5, None).select("stream_id", "frame_index", F.col("event_id").alias("entry"), "box.width")
    out = subtitles.frame_entries(views.frames(spark, sf_dir), shown, ["stream_id", "frame_index"])
    return out.select("stream_id", "frame_index", "event_id", F.col("entry").isNotNull().alias("shown"), "width")


@query(f"WITH {_DET} SELECT f.stream_id, f.frame_index FROM frames f WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.confidence >= 0.5 AND f.stream_id = d.stream_id AND f.frame_index = d.frame_index)")
def frame_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = detections.usable(views.detections(spark, sf_dir), 0.5, None)
    return subtitles.untouched_frames(views.frames(spark, sf_dir), shown, ["stream_id", "frame_index"]).select("stream_id", "frame_index")


# Schedules. Values come from whole-number arithmetic so that SQL has the same.

DURATION = 600.0
SPANS = [(a, b, float((i * 37) % 11)) for i, (a, b) in enumerate(schedules.intervals(DURATION, STEP))]
ZOOMS = [(a, b, 1 + (i * 29) % 7 / 100) for i, (a, b) in enumerate(schedules.intervals(DURATION, STEP))]
_SPANS = f"""spans AS (SELECT i AS seg_idx, i * {STEP} AS a, least((i + 1) * {STEP}, {DURATION}) AS b, ((i * 37) % 11)::double AS v, 1 + (i * 29) % 7 / 100.0::double AS z FROM (SELECT unnest(range(0, {int(DURATION / STEP)})) AS i) n), near AS (
    SELECT *, lag(v) OVER (ORDER BY seg_idx) AS vb, lead(v) OVER (ORDER BY seg_idx) AS va, lag(z) OVER (ORDER BY seg_idx) AS zb, lead(z) OVER (ORDER BY seg_idx) AS za FROM spans)"""


def _value(v: str, before: str, after: str, t: str = "t") -> str:
    half = WINDOW / 2
    return f"""CASE WHEN {t} <= 0 OR {t} >= {DURATION} THEN {v} WHEN {before} IS NOT NULL AND {t} > a - {half} AND {t} < a + {half} THEN {before} + ({v} - {before}) * (({t} - (a - {half})) / {WINDOW})
      WHEN {after} IS NOT NULL AND {t} > b - {half} AND {t} < b + {half} THEN {v} + ({after} - {v}) * (({t} - (b - {half})) / {WINDOW}) ELSE {v} END"""


_TIMES = f"times AS (SELECT o_orderkey, o_totalprice / 500 - 20 AS t FROM orders), spot AS (SELECT o_orderkey, t, greatest(0, least(floor(t / {STEP}), {int(DURATION / STEP) - 1}))::int AS i FROM times)"


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 500 - 20).alias("t"))


@query(
    f"""WITH s AS (SELECT i AS seg_idx, (i * {STEP} + least((i + 1) * {STEP}, 95.0)) / 2 AS m FROM (SELECT unnest(range(0, 10)) AS i) n)
    SELECT seg_idx::int AS seg_idx, round(greatest(0.9, least(1.1, 1.0 + 0.1 * sin(2 * pi() * 0.05 * m + 0.5))), 6) AS value FROM s"""
)
def schedule_sinusoidal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, (a + b) / 2) for i, (a, b) in enumerate(schedules.intervals(95.0, STEP))], "seg_idx int, m double")
    return rows.select("seg_idx", r6(schedules.sinusoid(F.col("m"), 0.9, 1.1, 0.05, 0.5)).alias("value"))


@query(f"WITH {_SPANS}, {_TIMES} SELECT o_orderkey, round({_value('v', 'vb', 'va')}, 9) AS level, round({_value('z', 'zb', 'za')}, 9) AS zoom FROM spot JOIN near ON i = seg_idx")
def schedule_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, zoom = (schedules.lookup(F.col("t"), rows, STEP, WINDOW) for rows in (SPANS, ZOOMS))
    return _times(spark, sf_dir).select("o_orderkey", F.round(level, 9).alias("level"), F.round(zoom, 9).alias("zoom"))


@query(f"WITH {_SPANS}, {_TIMES} SELECT o_orderkey, 'level' AS param, round({_value('v', 'vb', 'va')}, 9) AS value FROM spot JOIN near ON i = seg_idx UNION ALL SELECT o_orderkey, 'zoom', round({_value('z', 'zb', 'za')}, 9) FROM spot JOIN near ON i = seg_idx")
def schedule_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = schedules.to_table(spark, {"level": SPANS, "zoom": ZOOMS})
    return schedules.sample(_times(spark, sf_dir), plan, STEP, WINDOW).select("o_orderkey", "param", F.round("value", 9).alias("value"))


@query("""SELECT event_type, (epoch_us(ts) // 3600000000) * 3600000000 AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def tumbling_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.tumbling(table(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour", "value")
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n", r6("mean").alias("mean"))


def _uniform(seed: int, *parts: str) -> str:
    """SQL for numeric.uniform."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(p + '::varchar' for p in parts)})), 1, 13))::bigint / {float(1 << 52)}::double"


DRAWN = {"speed": (0.99, 1.01), "zoom": (1.0, 1.05), "gamma": (-0.02, 0.02)}
_CLIPS = "clips AS (SELECT s_suppkey AS clip, 200 + s_suppkey % 100 AS n FROM supplier)"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("clip"), (200 + F.col("s_suppkey") % 100).cast("long").alias("n"))


def _drawn(mode: str) -> str:
    """SQL for the schedules of one way to draw, over all clips."""
    ranges = ", ".join(f"('{p}', {a}::double, {b}::double)" for p, (a, b) in DRAWN.items())
    wave = "greatest(low, least(high, (low + high) / 2 + (high - low) / 2 * sin(2 * pi() * 0.1 * ({pace}) * ((a + b) / 2) + {phase})))"
    value = {
        "random": f"low + (high - low) * {_uniform(17, 'clip', 'param', 'i')}",
        "sinusoidal": wave.format(pace=f"0.8 + 0.4 * {_uniform(17, 'clip', 'param', chr(39) + 'frequency' + chr(39))}", phase=f"2 * pi() * {_uniform(17, 'clip', 'param', chr(39) + 'phase' + chr(39))}"),
        "correlated": wave.format(
            pace=f"0.9 + 0.2 * {_uniform(17, 'clip', 'param', chr(39) + 'frequency' + chr(39))}",
            phase=f"2 * pi() * {_uniform(17, 'clip')} + (2 * {_uniform(17, 'clip', 'param', chr(39) + 'phase' + chr(39))} - 1) * (pi() / 6)",
        ),
    }[mode]
    return f"""SELECT '{mode}' AS mode, clip, param, i::int AS seg_idx, round(a, 6) AS start_time, round(b, 6) AS end_time, round({value}, 6) AS value FROM (
      SELECT clip, param, low, high, i, i * 3.0::double AS a, least((i + 1) * 3.0::double, d) AS b FROM (SELECT clip, d, unnest(range(0, CASE WHEN d <= 3 THEN 1 ELSE ceil(d / 3.0::double)::bigint END)) AS i FROM (SELECT clip, n / {FPS}::double AS d FROM clips) c) s, (VALUES {ranges}) r(param, low, high)) x"""


@query(f"WITH {_CLIPS} {' UNION ALL '.join(_drawn(m) for m in schedules.MODES)}")
def schedule_random_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir).select("clip", (F.col("n") / FPS).alias("duration"))
    out = None
    for mode in schedules.MODES:
        made = schedules.drawn(clips, DRAWN, 3.0, mode, seed=17).select(F.lit(mode).alias("mode"), "clip", "param", "seg_idx", *[r6(c).alias(c) for c in ("start_time", "end_time", "value")])
        out = made if out is None else out.unionByName(made)
    return out


@query(
    f"""WITH {_CLIPS}, d AS (SELECT clip, i, 2 * pi() * {_uniform(19, 'clip', 'i', "'turn'")} AS turn, 0.3 + 0.7 * {_uniform(19, 'clip', 'i', "'size'")} AS size FROM (SELECT clip, unnest(range(0, 4)) AS i FROM clips) c)
    SELECT clip, i AS seg_idx, round(cos(turn) * size, 6) AS dx, round(sin(turn) * size, 6) AS dy FROM d"""
)
def drift_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("seg_idx"))
    return schedules.drift_directions(rows, 19, "clip", "seg_idx").select("clip", "seg_idx", r6("dx").alias("dx"), r6("dy").alias("dy"))


@query(
    f"""WITH {_SPANS} SELECT seg_idx::int AS seg_idx, a::double AS start_time, b::double AS end_time, v AS tempo, CASE WHEN seg_idx < 30 THEN round(z, 6) ELSE 1.0::double END AS bass, 0.5::double AS mid FROM spans"""
)
def schedule_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = schedules.to_table(spark, {"tempo": SPANS, "bass": ZOOMS[:30]})
    return schedules.align(plan, {"tempo": 1.0, "bass": 1.0, "mid": 0.5}).withColumn("bass", r6("bass"))


# Frame maps. Each stream is a clip whose speed changes with the interval of its frame number.

_MAP = f"""{_FRAMES}, sp AS (SELECT stream_id, frame_index, frame_index / {FPS} AS ft, count(*) OVER (PARTITION BY stream_id) AS n,
      CASE WHEN frame_index / {FPS} < 1 THEN 0.931::double WHEN frame_index / {FPS} < 2 THEN 1.171::double ELSE 1.063::double END AS speed FROM frames), run AS (
      SELECT *, sum(CASE WHEN frame_index = 0 THEN 0 ELSE speed / {FPS} END) OVER (PARTITION BY stream_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS it FROM sp), fm AS (
      SELECT stream_id, frame_index AS out_idx, greatest(0, least(round_even(it * {FPS}, 0)::bigint, n - 1)) AS in_idx FROM run), rp AS (
      SELECT stream_id, out_idx, CASE WHEN out_idx % 7 = 3 THEN coalesce(lag(in_idx) OVER (PARTITION BY stream_id ORDER BY out_idx), in_idx) ELSE in_idx END AS in_idx FROM fm)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir).select("stream_id", F.col("frame_index").cast("long").alias("out_idx"), (F.col("frame_index") / FPS).alias("t"))
    speed = timeline.speed_at(F.col("t"), [(0.0, 1.0, 0.931), (1.0, 2.0, 1.171), (2.0, 3.0, 1.063)], 1.0)
    n = F.count("*").over(Window.partitionBy("stream_id"))
    return timeline.frame_map(frames.withColumns({"speed": speed, "n": n}), ["stream_id"], FPS, F.col("n"))


@query(f"WITH {_MAP} SELECT * FROM fm")
def frame_map_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("stream_id", "out_idx", "in_idx")


@query(f"WITH {_MAP} SELECT * FROM rp")
def frame_map_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.repeat_previous(_mapped(spark, sf_dir), F.col("out_idx") % 7 == 3, ["stream_id"]).select("stream_id", "out_idx", "in_idx")


@query(f"WITH {_MAP} SELECT stream_id, in_idx, max(out_idx) AS last_out FROM rp GROUP BY stream_id, in_idx")
def last_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.last_use(frame_map_repeat(spark, sf_dir), ["stream_id"])


@query(f"WITH {_MAP} SELECT m.stream_id, m.out_idx, round(coalesce(f.value, 0), 6) AS value FROM fm m LEFT JOIN (SELECT * FROM frames WHERE event_id % 11 <> 0) f ON m.stream_id = f.stream_id AND m.in_idx = f.frame_index")
def frame_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = views.frames(spark, sf_dir).where("event_id % 11 <> 0")
    return timeline.look_up(frame_map_speed(spark, sf_dir), source, ["stream_id"], "value", 0.0).select("stream_id", "out_idx", r6("value").alias("value"))


_BUILT = f"""{_CLIPS}, sch AS (SELECT clip, i, i * 3.0::double AS a, least((i + 1) * 3.0::double, n / {FPS}::double) AS b, 0.99 + (1.01 - 0.99) * {_uniform(5, 'clip', "'speed'", 'i')} AS v, ceil(n / {FPS}::double / 3.0)::bigint AS k
      FROM (SELECT clip, n, unnest(range(0, ceil(n / {FPS}::double / 3.0)::bigint)) AS i FROM clips) c), moved AS (
      SELECT *, b + (2 * {_uniform(6, 'clip', 'i::int')} - 1) * 0.05 AS m, lead(b) OVER (PARTITION BY clip ORDER BY i) AS nb FROM sch), folded AS (
      SELECT clip, list_reduce(list({{'e': [CASE WHEN i = 0 THEN greatest(0.001, least(m, nb - 0.001)) ELSE m END], 'up': nb}} ORDER BY i), lambda s, x: {{'e': list_append(s.e, CASE WHEN x.up IS NULL THEN x.e[1] ELSE greatest(s.e[len(s.e)] + 0.001, least(x.e[1], x.up - 0.001)) END), 'up': x.up}}) AS f FROM moved GROUP BY clip), edges AS (
      SELECT s.clip, s.i, CASE WHEN s.i = 0 THEN 0 ELSE f.e[s.i] END AS a, CASE WHEN s.i = s.k - 1 THEN s.b ELSE f.e[s.i + 1] END AS b, v FROM sch s JOIN folded USING (clip)), fr AS (
      SELECT clip, n, unnest(range(0, n)) AS out_idx FROM clips), sp AS (
      SELECT fr.clip, fr.n, out_idx, v FROM fr JOIN edges e ON fr.clip = e.clip AND out_idx / {FPS}::double >= a AND out_idx / {FPS}::double < b), fm AS (
      SELECT clip, n, out_idx, greatest(0, least(round_even(sum(CASE WHEN out_idx = 0 THEN 0 ELSE v / {FPS} END) OVER (PARTITION BY clip ORDER BY out_idx ROWS UNBOUNDED PRECEDING) * {FPS}, 0)::bigint, n - 1)) AS in_idx FROM sp), h AS (
      SELECT *, CASE WHEN out_idx BETWEEN 1 AND n - 2 THEN {_uniform(6, 'clip', 'out_idx')} END AS h FROM fm), low AS (
      SELECT *, coalesce(h < coalesce(lag(h) OVER w, 1) AND h < coalesce(lead(h) OVER w, 1), false) AS low, lag(in_idx) OVER w AS before FROM h WINDOW w AS (PARTITION BY clip ORDER BY out_idx)), pick AS (
      SELECT *, low AND row_number() OVER (PARTITION BY clip ORDER BY CASE WHEN low THEN h END NULLS LAST, out_idx) <= floor({_uniform(6, 'clip', "'places'")} * (floor(n * 2.0 / 100) + 1)) AS again FROM low)"""


@query(f"WITH {_BUILT} SELECT clip, out_idx, CASE WHEN again THEN coalesce(before, in_idx) ELSE in_idx END AS in_idx FROM pick")
def frame_map_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir)
    speeds = schedules.drawn(clips.select("clip", (F.col("n") / FPS).alias("duration")), {"speed": (0.99, 1.01)}, 3.0, "random", seed=5)
    return timeline.build_map(clips, FPS, speeds.drop("param"), 3.0, 0.05, 2.0, 6)


@query(
    f"""WITH {_MAP}, w AS (SELECT stream_id, out_idx, in_idx, count(*) OVER (PARTITION BY stream_id) AS have, CASE WHEN stream_id % 3 = 0 THEN (count(*) OVER (PARTITION BY stream_id) * 4) // 5 WHEN stream_id % 3 = 1 THEN (count(*) OVER (PARTITION BY stream_id) * 6) // 5 ELSE count(*) OVER (PARTITION BY stream_id) END AS n FROM fm), lim AS (
      SELECT *, trunc(n * 0.99::double)::bigint AS low, trunc(n * 1.01::double)::bigint AS high FROM w), e AS (SELECT stream_id, have, max(low) AS low, arg_max(in_idx, out_idx) AS last FROM lim GROUP BY stream_id, have)
    SELECT stream_id, out_idx, in_idx FROM lim WHERE out_idx < high UNION ALL SELECT stream_id, unnest(range(have, low)), last FROM e WHERE have < low"""
)
def frame_map_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.count("*").over(Window.partitionBy("stream_id"))
    wanted = F.when(F.col("stream_id") % 3 == 0, F.floor(have * 4 / 5)).when(F.col("stream_id") % 3 == 1, F.floor(have * 6 / 5)).otherwise(have)
    return timeline.fit_length(frame_map_speed(spark, sf_dir).withColumn("wanted", wanted), ["stream_id"], F.col("wanted"))


@query(f"WITH {_MAP} SELECT m.stream_id, m.out_idx, round(f.value, 6) AS value FROM fm m JOIN (SELECT stream_id, max(frame_index) AS last FROM frames WHERE frame_index < 10 GROUP BY stream_id) l ON l.stream_id = m.stream_id JOIN frames f ON m.stream_id = f.stream_id AND f.frame_index = least(m.in_idx, l.last)")
def frame_map_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places beyond the input, of which ten frames are there, show its last frame."""
    source = views.frames(spark, sf_dir).where("frame_index < 10")
    return timeline.look_up_or_last(frame_map_speed(spark, sf_dir), source, ["stream_id"], "value", 0.0).select("stream_id", "out_idx", r6("value").alias("value"))


@query(f"WITH {_CLIPS} SELECT clip, (15 + least(105, floor({_uniform(23, 'clip')} * 106)))::bigint AS gop FROM clips")
def gop_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (F.lit(config.PRESETS["medium"][k]) for k in ("gop_min", "gop_max"))
    return _clips(spark, sf_dir).select("clip", N.whole_between(low, high, 23, "clip").cast("long").alias("gop"))


_DRIFT = f"""dr AS (SELECT seg_idx, a, b, ((seg_idx * 13) % 9 - 4) / 8.0::double AS dx, ((seg_idx * 7) % 9 - 4) / 8.0::double AS dy FROM spans), acc AS (
    SELECT *, coalesce(sum(0.005 * {W} * dx * (b - a)) OVER (ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ox, coalesce(sum(0.005 * {H} * dy * (b - a)) OVER (ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS oy FROM dr), off AS (
    SELECT o_orderkey, t, i, ox + 0.005 * {W} * dx * greatest(0, least(t, acc.b) - acc.a) AS x, oy + 0.005 * {H} * dy * greatest(0, least(t, acc.b) - acc.a) AS y FROM spot JOIN acc ON i = acc.seg_idx)"""


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, i, a, b, ((i * 13) % 9 - 4) / 8, ((i * 7) % 9 - 4) / 8) for i, (a, b) in enumerate(schedules.intervals(DURATION, STEP))]
    plan = timeline.drift(spark.createDataFrame(rows, "stream_id int, seg_idx int, start_time double, end_time double, dx double, dy double"), W, H)
    s = F.struct("start_time", "end_time", "dx", "dy", "offset_x", "offset_y").alias("s")
    index = F.greatest(F.lit(0), F.least(F.floor(F.col("t") / STEP).cast("int"), F.lit(len(rows) - 1)))
    at = _times(spark, sf_dir).withColumn("seg_idx", index).join(F.broadcast(plan.select("seg_idx", s)), "seg_idx")
    x, y = timeline.drift_at(F.col("t"), F.col("s"), W, H)
    return at.select("o_orderkey", "t", x.alias("x"), y.alias("y"))


@query(f"WITH {_SPANS}, {_TIMES}, {_DRIFT} SELECT o_orderkey, round(x, 4) AS x, round(y, 4) AS y FROM off")
def drift_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).select("o_orderkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    f"""WITH {_SPANS}, {_TIMES}, {_DRIFT}, p AS (SELECT off.*, greatest((1 - ({_value('v', 'vb', 'va')}) / 100.0) / ({_value('z', 'zb', 'za')}), 0.01) AS share FROM off JOIN near ON i = seg_idx), c AS (
      SELECT o_orderkey, x, y, greatest(1, round_even({W} * share, 0)) AS w, greatest(1, round_even({H} * share, 0)) AS h FROM p)
    SELECT o_orderkey, greatest(0, least(round_even({W} / 2.0 + x - w / 2.0, 0), {W} - w))::int AS x, greatest(0, least(round_even({H} / 2.0 + y - h / 2.0, 0), {H} - h))::int AS y, w::int AS width, h::int AS height FROM c"""
)
def crop_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _offsets(spark, sf_dir).withColumns({c: schedules.lookup(F.col("t"), rows, STEP, WINDOW) for c, rows in (("crop", SPANS), ("zoom", ZOOMS))})
    b = G.crop_region(F.lit(W), F.lit(H), F.col("crop"), F.col("zoom"), F.col("x"), F.col("y"))
    return both.select("o_orderkey", b.alias("b")).select("o_orderkey", *flat("b"))


# Scenes. Each embedding stands for the histogram of a frame.

CLIP = 100  # consecutive vectors that make a clip

_HIST = f"""h AS (SELECT vec_id // {CLIP} AS clip, vec_id % {CLIP} AS f, list_transform(embedding, lambda x: x::double) AS a, lag(list_transform(embedding, lambda x: x::double)) OVER (PARTITION BY vec_id // {CLIP} ORDER BY vec_id) AS b FROM embeddings), p AS (
    SELECT clip, f, list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) AS ab, list_sum(list_transform(a, lambda x: x * x)) AS aa, list_sum(list_transform(b, lambda x: x * x)) AS bb, list_sum(a) AS sa, list_sum(b) AS sb, len(a) AS n FROM h WHERE b IS NOT NULL), d AS (
    SELECT clip, f, 1 - coalesce((ab - sa * sb / n) / nullif(sqrt((aa - sa * sa / n) * (bb - sb * sb / n)), 0), 1) AS diff FROM p)"""
_CUTS = f"{_HIST}, cut AS (SELECT * FROM d WHERE diff > 0.9), total AS (SELECT clip, max(f) + 1 AS n FROM h GROUP BY clip)"
_SCENES = f"""{_CUTS}, st AS (SELECT clip, f AS a FROM cut UNION ALL SELECT clip, 0 FROM total), sc AS (SELECT clip, a, coalesce(lead(a) OVER (PARTITION BY clip ORDER BY a), n) AS b FROM st JOIN total USING (clip)), ok AS (
    SELECT clip, a AS start_frame, b AS end_frame, a / {FPS} AS start_time, b / {FPS} AS end_time, (b / {FPS} - a / {FPS}) < 0.1 AS is_micro FROM sc WHERE b > a)"""


def _hist_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.floor(vec / CLIP).alias("clip"), (vec % CLIP).alias("frame_index"), F.col("embedding").cast("array<double>").alias("hist"))


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _hist_frames(spark, sf_dir)
    cuts = scenes.boundaries(frames, ["clip"], "frame_index", "hist", 0.9).select("clip", "frame_index")
    return scenes.scenes(cuts, frames.groupBy("clip").agg((F.max("frame_index") + 1).alias("n_frames")), ["clip"], FPS, 0.1)


@query(f"WITH {_CUTS} SELECT clip, f AS frame_index, round(f / {FPS}, 6) AS t, round(diff, 6) AS diff FROM cut")
def scene_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = scenes.boundaries(_hist_frames(spark, sf_dir), ["clip"], "frame_index", "hist", 0.9)
    return cuts.select("clip", "frame_index", r6(F.col("frame_index") / FPS).alias("t"), r6("diff").alias("diff"))


@query(f"WITH {_SCENES} SELECT clip, start_frame, end_frame, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, is_micro FROM ok")
def scene_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir).select("clip", "start_frame", "end_frame", r6("start_time").alias("start_time"), r6("end_time").alias("end_time"), "is_micro")


@query(
    f"""WITH {_SCENES}, l AS (SELECT *, end_time - start_time AS own, lag(end_time - start_time) OVER (PARTITION BY clip ORDER BY start_frame) AS before FROM ok), s AS (
      SELECT *, start_time - coalesce(least(0.5, before, own) / 2, 0) AS moved FROM l)
    SELECT clip, end_frame, CASE WHEN before IS NULL THEN start_frame ELSE greatest(0, round_even(moved * ((end_frame - start_frame) / own), 0)::bigint) END AS start_frame, round(CASE WHEN before IS NULL THEN start_time ELSE greatest(0, moved) END, 6) AS start_time FROM s"""
)
def scene_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.overlaps(_scenes(spark, sf_dir), ["clip"], 0.5).select("clip", "end_frame", "start_frame", r6("start_time").alias("start_time"))


@query(f"WITH {_SCENES} SELECT clip, start_frame, unnest(generate_series(start_frame, end_frame - 1)) AS frame_index FROM ok")
def scene_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.frames_of(_scenes(spark, sf_dir), ["clip"]).select("clip", "start_frame", "frame_index")


@query(
    f"""WITH {_SCENES}, pl AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY start_frame) AS place FROM ok), nu AS (
      SELECT *, row_number() OVER (PARTITION BY clip, is_micro ORDER BY place) AS nth, row_number() OVER (PARTITION BY clip, is_micro ORDER BY {_uniform(3, 'clip', 'start_frame')}, start_frame) AS dr, count(*) OVER (PARTITION BY clip, is_micro) AS c FROM pl), sa AS (
      SELECT *, min((nth = dr)::int) OVER (PARTITION BY clip, is_micro) AS same FROM nu), ta AS (SELECT *, CASE WHEN same = 1 THEN nth % c + 1 ELSE dr END AS goal FROM sa WHERE is_micro)
    SELECT clip, place, start_frame, end_frame, is_micro FROM pl WHERE NOT is_micro UNION ALL SELECT ta.clip, t.place, ta.start_frame, ta.end_frame, ta.is_micro FROM ta JOIN ta t ON ta.clip = t.clip AND ta.goal = t.nth"""
)
def scene_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.reorder(_scenes(spark, sf_dir), ["clip"], 3).select("clip", F.col("place").cast("long"), "start_frame", "end_frame", "is_micro")


@query(
    """WITH c AS (SELECT l_returnflag, least(49, floor((l_quantity * 3.5) / 3.6))::int AS bin_a, least(59, floor((l_discount * 2000) / (256.0 / 60)))::int AS bin_b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_returnflag, bin_a, bin_b, n, round(n / sqrt(sum(n * n::double) OVER (PARTITION BY l_returnflag)), 6) AS share FROM c"""
)
def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 3.5).alias("hue"), (F.col("l_discount") * 2000).alias("sat"))
    out = scenes.histogram(pixels, ["l_returnflag"], "hue", "sat")
    return out.withColumn("share", r6("share"))


# Numbers.


@query("SELECT g AS gamma, i::int AS level, least(255, trunc(power(i / 255.0::double, 1 / g) * 255))::int AS out FROM (SELECT unnest([0.96::double, 1.02, 1.04]) AS g) a, (SELECT unnest(range(0, 256)) AS i) b")
def gamma_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = spark.createDataFrame([(0.96,), (1.02,), (1.04,)], "gamma double")
    return curves.select("gamma", F.posexplode(N.gamma_curve(F.col("gamma"))).alias("level", "out"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(255, trunc((l_quantity * 5 - m) * 1.03 + m)))::int AS level FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity * 5) AS m FROM lineitem GROUP BY 1) a USING (l_returnflag)")
def contrast_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") * 5).alias("v"))
    joined = pixels.join(pixels.groupBy("l_returnflag").agg(F.avg("v").alias("m")), "l_returnflag")
    return joined.select("l_orderkey", "l_linenumber", N.contrast(F.col("v"), F.col("m"), F.lit(1.03)).alias("level"))


@query("SELECT p_partkey, round(((p_size * 7 % 180 - 3.5::double) % 180 + 180) % 180, 6) AS hue, round(least(255, p_size * 5 * 1.03::double), 6) AS saturation FROM part")
def hue_sat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hue, sat = N.shift_hue(F.col("p_size") * 7 % 180, F.lit(-7.0)), N.scale_saturation(F.col("p_size") * 5, F.lit(1.03))
    return table(spark, sf_dir, "part").select("p_partkey", r6(hue).alias("hue"), r6(sat).alias("saturation"))


@query("SELECT c::int AS col, r::int AS row, round(power(least(1, sqrt(power(c / 63.0 * 2 - 1, 2) + power(r / 35.0 * 2 - 1, 2)) / sqrt(2)), 2), 6) AS shade FROM (SELECT unnest(range(0, 64)) AS c) a, (SELECT unnest(range(0, 36)) AS r) b")
def vignette(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(64 * 36).select((F.col("id") % 64).cast("int").alias("col"), F.floor(F.col("id") / 64).cast("int").alias("row"))
    return grid.select("col", "row", r6(N.vignette(F.col("col"), F.col("row"), 64, 36)).alias("shade"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(255, trunc(l_quantity * 5 + 0.03 * (l_orderkey % 257 - 128) - l_discount * 0.5 * 0.03 * 255)))::int AS level FROM lineitem")
def overlay_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise, shade = F.col("l_orderkey") % 257 - 128, F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.overlay(F.col("l_quantity") * 5, noise, shade, F.lit(0.03), 0.5).alias("level"))


def _turned(n: int) -> str:
    """SQL for a channel of picture.from_hsv."""
    k = f"(({n} + h2 / 30.0::double) - 6 * floor(({n} + h2 / 30.0::double) / 6))"
    return f"round_even(v * (1 - s2 / 255.0::double * greatest(0, least({k}, 4 - {k}, 1))), 0)::int"


@query(
    f"""WITH px AS (SELECT l_orderkey, l_linenumber, (l_quantity * 5)::int AS r, (l_partkey % 256)::int AS g, (l_suppkey * 7 % 256)::int AS b, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 1.02::double END AS gamma, CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 1.03::double END AS contrast,
      CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 1.1::double END AS saturation, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE -7.0::double END AS hue FROM lineitem), ga AS (
      SELECT * REPLACE ({', '.join(f"CASE WHEN gamma = 1 THEN {c} ELSE least(255, trunc(power({c} / 255.0::double, 1 / gamma) * 255))::int END AS {c}" for c in 'rgb')}) FROM px), me AS (SELECT *, avg((r + g + b) / 3.0::double) OVER (PARTITION BY l_orderkey) AS m FROM ga), co AS (
      SELECT * REPLACE ({', '.join(f"CASE WHEN contrast = 1 THEN {c} ELSE greatest(0, least(255, trunc(({c} - m) * contrast + m)))::int END AS {c}" for c in 'rgb')}) FROM me), ex AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS span FROM co), tu AS (
      SELECT *, CASE WHEN span = 0 THEN 0 WHEN v = r THEN 60 * (g - b) / span::double WHEN v = g THEN 120 + 60 * (b - r) / span::double ELSE 240 + 60 * (r - g) / span::double END AS turn FROM ex), hs AS (
      SELECT *, round_even(((turn % 360 + 360) % 360) / 2, 0)::int % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE round_even(255 * span::double / v, 0)::int END AS s FROM tu), mv AS (SELECT *, floor(((h + hue / 2) % 180 + 180) % 180)::int AS h2, floor(greatest(0, least(255, s * saturation)))::int AS s2 FROM hs)
    SELECT l_orderkey, l_linenumber, {', '.join(f"CASE WHEN saturation = 1 AND hue = 0 THEN {c} ELSE {_turned(n)} END AS {c}" for c, n in (('r', 5), ('g', 3), ('b', 1)))} FROM mv"""
)
def colour_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("l_orderkey")
    pixels = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") * 5).cast("int").alias("r"),
        (F.col("l_partkey") % 256).cast("int").alias("g"),
        (F.col("l_suppkey") * 7 % 256).cast("int").alias("b"),
        F.when(order % 3 == 0, 1.0).otherwise(1.02).alias("gamma"),
        F.when(order % 5 == 0, 1.0).otherwise(1.03).alias("contrast"),
        F.when(order % 2 == 0, 1.0).otherwise(1.1).alias("saturation"),
        F.when(order % 2 == 0, 0.0).otherwise(-7.0).alias("hue"),
    )
    return picture.colour_chain(pixels, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "r", "g", "b")


@query(f"SELECT l_orderkey, l_linenumber, (floor({_uniform(11, 'l_orderkey', 'l_linenumber')} * 257) - 128)::int AS grain FROM lineitem")
def grain_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.grain(11, "l_orderkey", "l_linenumber").alias("grain"))


_GRID = 8


@query(
    f"""WITH g AS (SELECT c, r, k FROM (SELECT unnest(range(0, {_GRID})) AS c) a, (SELECT unnest(range(0, {_GRID})) AS r) b, (SELECT unnest(range(0, 10)) AS k) d)
    SELECT k::int AS k, c::int AS col, r::int AS row, round((1 + (c + r) % 3) * sin(2 * pi() * (0.1 + c / 50.0::double) * (k / 2.0) + r) * least(1, least(c, {_GRID - 1} - c) / 2.0) * least(1, least(r, {_GRID - 1} - r) / 2.0), 6) AS dx FROM g"""
)
def warp_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _GRID * _GRID
    cells = spark.range(10 * n).select(F.floor(F.col("id") / n).cast("int").alias("k"), (F.col("id") % _GRID).cast("int").alias("col"), (F.floor(F.col("id") / _GRID) % _GRID).cast("int").alias("row"))
    moved = N.wave((1 + (F.col("col") + F.col("row")) % 3).cast("double"), 0.1 + F.col("col") / 50.0, F.col("row").cast("double"), F.col("k") / 2.0)
    return cells.select("k", "col", "row", r6(moved * N.edge_factor(F.col("col"), _GRID) * N.edge_factor(F.col("row"), _GRID)).alias("dx"))


_FINE = 32


@query(
    f"""WITH x AS (SELECT i, greatest(0, least({_GRID - 1}, (i + 0.5) * {_GRID / _FINE} - 0.5)) AS p FROM (SELECT unnest(range(0, {_FINE})) AS i) a), y AS (SELECT i, p, floor(p) AS lo, least({_GRID - 1}, floor(p) + 1) AS hi, p - floor(p) AS f FROM x)
    SELECT a.i::int AS col, b.i::int AS row, round((a.lo * b.lo % 5) * (1 - a.f) * (1 - b.f) + (a.hi * b.lo % 5) * a.f * (1 - b.f) + (a.lo * b.hi % 5) * (1 - a.f) * b.f + (a.hi * b.hi % 5) * a.f * b.f, 6)::double AS v FROM y a, y b"""
)
def warp_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.broadcast(spark.range(_GRID * _GRID).select((F.col("id") % _GRID).alias("c"), F.floor(F.col("id") / _GRID).alias("r"), ((F.col("id") % _GRID) * F.floor(F.col("id") / _GRID) % 5).cast("double").alias("v")))
    fine = spark.range(_FINE * _FINE).select((F.col("id") % _FINE).cast("int").alias("col"), F.floor(F.col("id") / _FINE).cast("int").alias("row"))

    def spot(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(_GRID - 1.0), (F.col(c) + 0.5) * (_GRID / _FINE) - 0.5))

    out = fine.withColumns({"px": spot("col"), "py": spot("row")})
    for name, dx, dy in (("v00", 0, 0), ("v01", 1, 0), ("v10", 0, 1), ("v11", 1, 1)):
        corner = grid.select(F.col("c").alias("_c"), F.col("r").alias("_r"), F.col("v").alias(name))
        at = [F.least(F.lit(_GRID - 1).cast("long"), F.floor(p) + d) for p, d in (("px", dx), ("py", dy))]
        out = out.join(corner, (at[0] == F.col("_c")) & (at[1] == F.col("_r"))).drop("_c", "_r")
    v = N.bilinear(*[F.col(c) for c in ("v00", "v01", "v10", "v11")], F.col("px") - F.floor("px"), F.col("py") - F.floor("py"))
    return out.select("col", "row", r6(v).alias("v"))


@query(
    """SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms, round(sqrt(avg(value * value)) * power(10, -30 / 20.0), 6) AS noise, round(power(10, 2 / 20.0) - 1, 6) AS gain FROM events GROUP BY event_type"""
)
def rms_noise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(rms.alias("rms"))
    return out.select("event_type", r6("rms").alias("rms"), r6(N.noise_amplitude(F.col("rms"), F.lit(-30.0))).alias("noise"), r6(N.extra_gain(F.lit(2.0))).alias("gain"))


@query("SELECT p_partkey, round(1 / (1 + (1 / (2 * pi() * (0.3 + 0.5 * p_size))) / (1 + p_partkey % 3)), 6) AS alpha FROM part")
def one_euro_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = N.one_euro_alpha(0.3 + 0.5 * F.col("p_size"), 1 + F.col("p_partkey") % 3)
    return table(spark, sf_dir, "part").select("p_partkey", r6(alpha).alias("alpha"))


# Layout.


def _planned(spark: SparkSession, sf_dir: str, fixed: Column | None) -> DataFrame:
    style = layout.Style(grow=(1.5, 1.3), max_lines=3, condensed=0.8)
    b = G.box(F.col("p_partkey") % 1500, F.col("p_partkey") % 900, 60 + F.col("p_size") * 4, 16 + F.col("p_size") % 40)
    out = table(spark, sf_dir, "part").select("p_partkey", layout.plan(F.col("p_name"), b, style, W, H, fixed).alias("plan"))
    return out.select("p_partkey", *flat("plan.box"), "plan.narrow", "plan.size", F.array_join("plan.lines", "\n").alias("lines"))


@query()
def layout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir, None)


@query()
def layout_plan_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a size of the segment's own, which a moving text keeps; boxes give way before it does."""
    return _planned(spark, sf_dir, 12 + F.col("p_partkey") % 70)


@query(
    """WITH s AS (SELECT p_partkey, length(p_name) AS n, 60 + p_size * 4 AS w, 16 + p_size % 40 AS h FROM part), f AS (SELECT p_partkey, z, ceil(n * z * 0.6) <= w AND ceil(z * 1.2) <= h AS ok FROM s, (SELECT unnest(range(12, 49)) AS z) a)
    SELECT p_partkey, max(CASE WHEN ok THEN z END)::int AS size FROM f GROUP BY p_partkey"""
)
def layout_auto_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box(F.lit(0), F.lit(0), 60 + F.col("p_size") * 4, 16 + F.col("p_size") % 40)
    return table(spark, sf_dir, "part").select("p_partkey", layout.auto_fit(F.array("p_name"), b, layout.Style()).alias("size"))


# Configuration.


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else "NULL" if v is None else repr(v) for v in r) + ")" for r in rows) + ")"


_BASE = {"detector": {"threshold": 0.5, "stride": 3}, "render": {"size": 24, "font": "a.ttf"}, "mode": "cpu"}
_OVER = {"detector": {"stride": 1}, "render": {"font": "b.ttf", "stroke": 2}}
_LAYERS = [(k, v, p) for p, layer in enumerate((_BASE, _OVER, {"mode": "gpu"})) for k, v in config.leaves(layer)]


@query(f"SELECT param, arg_max(value, priority) AS value FROM {_values(_LAYERS)} t(param, value, priority) WHERE value IS NOT NULL GROUP BY param")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.merge_layers(spark.createDataFrame(_LAYERS, "param string, value string, priority int"))


_RANGES = _values([(k, float(a), float(b)) for k, (a, b) in config.RANGES.items()])
_CASES = [(p, k, float(v) * f) for p, values in config.PRESETS.items() for f in (1.0, 1.25) for k, v in values.items() if not isinstance(v, str)]


@query(f"SELECT preset, v.param, value::double AS value, coalesce(value BETWEEN low AND high, true) AS valid FROM {_values(_CASES)} v(preset, param, value) LEFT JOIN {_RANGES} r(param, low, high) ON v.param = r.param")
def config_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(_CASES, "preset string, param string, value double")
    return config.check_table(cases, config.ranges_table(spark)).select("preset", "param", "value", "valid")


_NEUTRAL = _values([(g, k, float(v)) for g, values in config.NEUTRAL.items() for k, v in values.items()])


@query(f"SELECT preset, v.param, round(coalesce(neutral + (value - neutral) * 0.5, value), 6)::double AS scaled FROM {_values(_CASES)} v(preset, param, value) LEFT JOIN {_NEUTRAL} n(grp, param, neutral) ON v.param = n.param AND n.grp IN ('temporal', 'audio')")
def combo_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(_CASES, "preset string, param string, value double")
    return config.scale_table(cases, 0.5, ["temporal", "audio"]).select("preset", "param", r6("scaled").alias("scaled"))


_FILE = {"temporal": {"speed_min": 0.95}, "gop": {"gop_max": 200}, "presets": {"light": {"spatial": {"max_zoom": 1.5}}}}
_GIVEN = {"hue_range": 4.0, "speed_max": 1.09}
_RESOLVED = [
    (p, k, v, i)
    for p in config.CHOICES["preset"]
    for i, layer in enumerate((config.DEFAULTS, {"max_zoom": 1.5} if p == "light" else config.PRESETS[p], {"speed_min": 0.95, "gop_max": 200}, _GIVEN))
    for k, v in layer.items()
    if isinstance(v, (int, float)) and not isinstance(v, bool)
]


@query(f"SELECT preset, param, arg_max(value::double, priority) AS value FROM {_values(_RESOLVED)} t(preset, param, value, priority) GROUP BY preset, param")
def settings_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, a preset of the engine or of the file, the file's sections and overrides, each above the one before."""
    found = {p: config.resolve(_FILE, p, _GIVEN) for p in config.CHOICES["preset"]}
    rows = [(p, k, float(v)) for p, values in found.items() for k, v in values.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "preset string, param string, value double")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-c:v h264_nvenc -preset ' || CASE p_size % 3 WHEN 0 THEN 'p1' WHEN 1 THEN 'p4' ELSE 'p5' END || ' -rc vbr -cq 23 -b:v 0'
      WHEN 1 THEN '-c:v h264_qsv -preset ' || CASE p_size % 3 WHEN 0 THEN 'veryfast' WHEN 1 THEN 'fast' ELSE 'medium' END || ' -global_quality 23'
      WHEN 2 THEN '-c:v h264_amf -quality ' || CASE p_size % 3 WHEN 0 THEN 'speed' WHEN 1 THEN 'balanced' ELSE 'quality' END || ' -rc vbr_latency -qp_i 23 -qp_p 23'
      ELSE '-c:v libx264 -preset ' || CASE p_size % 3 WHEN 0 THEN 'ultrafast' WHEN 1 THEN 'veryfast' ELSE 'medium' END || ' -crf 23 -threads 8' END AS arguments FROM part"""
)
def encoder_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("h264_nvenc", "h264_qsv", "h264_amf", "other")))
    levels = F.array(*map(F.lit, ("ultrafast", "fast", "medium")))
    jobs = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("encoder"), F.get(levels, F.col("p_size") % 3).alias("preset"))
    return config.encoder_arguments(jobs).select("p_partkey", "arguments")


@query(
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT (p_size % 2 = 0 AND p_partkey % 2 = 0) THEN 'spatial' END, CASE WHEN p_size % 3 > 0 THEN 'warp' END, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 7 > 0 THEN 'rotation' END, 'color_drift', CASE WHEN p_size % 5 > 0 AND p_partkey % 3 > 0 THEN 'overlay' END], lambda x: x IS NOT NULL), ' ') AS transforms FROM part"""
)
def active_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which transforms change a frame, in order: those that are enabled and whose ranges are not without effect."""
    size, i = F.col("p_size"), F.col("p_partkey")
    drawn = {"max_crop_percent": size % 2, "max_zoom": 1 + i % 2, "warp_max_displacement": size % 3, "max_rotation_degrees": i % 5, "overlay_opacity_max": size % 5, "hue_range": F.lit(1.0)}
    switches = {"overlay_grain_enabled": i % 3 > 0, "overlay_vignette_enabled": F.lit(False), "rotation_enabled": i % 7 > 0}
    rest = {k: F.lit(v) for k, v in config.resolve({}).items() if v is not None}
    jobs = table(spark, sf_dir, "part").withColumns(rest | drawn | switches)
    return config.active_transforms(jobs).select("p_partkey", F.array_join("transforms", " ").alias("transforms"))


@query(
    f"""WITH {_DET} SELECT event_id, list_filter([CASE WHEN NOT (w > 30) THEN 'box size' END, CASE WHEN NOT (confidence BETWEEN 0.1 AND 0.9) THEN 'confidence' END], lambda x: x IS NOT NULL)::varchar = '[]' AS valid FROM det"""
)
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelattice.schemas import validate

    rules = {"box size": F.col("box.width") > 30, "confidence": F.col("confidence").between(0.1, 0.9)}
    return validate(views.detections(spark, sf_dir), rules).select("event_id", (F.size("violations") == 0).alias("valid"))


# Streams.


@query(_SESSIONS)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    found = streams.sessions(streams.read_stream(spark, sf_dir, schema, "events.parquet"), ["user_id"], "ts", f"{int(GAP)} seconds")
    folder = storage.new_folder(spark, "sessions")
    out = _sessions(streams.run_available(found, "complete", folder))
    storage.remove(spark, f"{folder}/state")
    return out


@query()
def stream_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that arrive range by range of frames, tracked as a stream that goes on where it stopped."""
    folder = storage.new_folder(spark, "track")
    det = detections.usable(views.detections(spark, sf_dir), 0.5, None).select("stream_id", "frame_index", "t", "box", "text").withColumn("ends", F.lit(False))
    ends = det.groupBy("stream_id").agg((F.max("frame_index") + 1).alias("frame_index")).select("stream_id", "frame_index", F.lit(0.0).alias("t"), F.lit(None).cast(G.BOX).alias("box"), F.lit("").alias("text"), F.lit(True).alias("ends"))
    rows = det.unionByName(ends)
    until = rows.agg(F.max("frame_index").alias("n")).first()["n"] or 0
    out = None
    for part in range(3):
        low, high = part * (until // 3 + 1), (part + 1) * (until // 3 + 1)
        rows.where(F.col("frame_index").between(low, high - 1)).write.parquet(f"{folder}/in/part={part}")
        source = streams.read_stream(spark, f"{folder}/in", rows.schema, files=1 << 20)  # a range of frames is one batch
        out = streams.run_available(streams.track_stream(source), "append", folder)
    for done in ("in", "state"):  # only what was put out is still read
        storage.remove(spark, f"{folder}/{done}")
    return out


# Audio.


@query()
def audio_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tones of a length and pitch of their own, with tempo, equaliser and noise of their own, one after another in a clip."""
    i, size = F.col("p_partkey"), F.col("p_size")
    tone = F.transform(F.sequence(F.lit(0), 199 + size), lambda k: F.round(6000 * F.sin(2 * math.pi * (100 + 37 * size) * k / 8000.0)).cast("int"))
    made = table(spark, sf_dir, "part").select(
        (i % 97).cast("long").alias("clip"), F.floor(i / 97).alias("seg_idx"), tone.alias("samples"), (0.97 + (i % 7) / 100).alias("tempo"), (i % 5 - 2).alias("bass"), (i % 3 - 1).alias("mid"), F.lit(0.0).alias("treble"), F.lit(-35.0).alias("noise_db")
    )
    out = audio.concatenated(audio.process(made, 8000.0, 29))
    return out.select("clip", "seg_idx", "start", F.size("samples").cast("long").alias("n_samples"), F.array_max("samples").alias("peak"))
