"""Frame maps: which input frame stands at each place of an output clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions import numeric as N

MAX_DRIFT = 0.005  # share of a frame's side a second


def jitter(schedule: DataFrame, most: float, seed: int, gap: float = 0.001) -> DataFrame:
    """A schedule (clip, seg_idx, start_time, end_time, value) with its inner boundaries moved.

    Each by up to most seconds, as its clip and number are hashed, and then kept gap seconds
    from the boundary before, as moved, and the one after, as it was. A clip's boundaries are
    folded in order, in one row of the clip.
    """
    moved = F.col("end_time") + (2 * N.uniform(seed, "clip", "seg_idx") - 1) * most
    edge = F.struct("seg_idx", "start_time", "end_time", "value", moved.alias("moved"))
    clips = schedule.groupBy("clip").agg(F.sort_array(F.collect_list(edge)).alias("s"))

    def step(edges: Column, i: Column) -> Column:
        here, after = F.get("s", i), F.get("s", i + 1)
        kept = F.greatest(F.element_at(edges, -1) + gap, F.least(here["moved"], after["end_time"] - gap))
        return F.concat(edges, F.array(kept))

    inner = F.when(F.size("s") > 1, F.sequence(F.lit(0), F.size("s") - 2)).otherwise(F.array().cast("array<int>"))
    edges = F.aggregate(inner, F.array(F.lit(0.0)), step)
    whole = F.concat(edges, F.array(F.element_at("s", -1)["end_time"]))
    spans = clips.select("clip", "s", whole.alias("e")).select("clip", "e", F.posexplode("s").alias("i", "r"))
    return spans.select("clip", "r.seg_idx", F.get("e", F.col("i")).alias("start_time"), F.get("e", F.col("i") + 1).alias("end_time"), "r.value")


def repeated_places(frames: DataFrame, percent: float, seed: int) -> DataFrame:
    """frames(clip, out_idx, n, …) with repeats: random inner places, no two next to each other, up to a share of n.

    How many is drawn for each clip. A place may be chosen if its hash is below that of both
    its neighbours; of these the ones with the smallest hashes are.
    """
    order = Window.partitionBy("clip").orderBy("out_idx")
    inner = F.col("out_idx").between(1, F.col("n") - 2)
    marked = frames.withColumn("_h", F.when(inner, N.uniform(seed, "clip", "out_idx")))
    low = F.col("_h").isNotNull()
    for side in (F.lag("_h").over(order), F.lead("_h").over(order)):
        low = low & (F.col("_h") < F.coalesce(side, F.lit(1.0)))
    marked = marked.withColumn("_h", F.when(low, F.col("_h")))
    rank = F.row_number().over(Window.partitionBy("clip").orderBy(F.col("_h").asc_nulls_last(), "out_idx"))
    wanted = F.floor(N.uniform(seed, "clip", F.lit("places")) * (F.floor(F.col("n") * percent / 100) + 1))
    return marked.withColumn("repeats", F.col("_h").isNotNull() & (rank <= wanted)).drop("_h")


def speed_of(frames: DataFrame, schedule: DataFrame, step: float) -> DataFrame:
    """frames(clip, t, …) with the speed of the interval [start, end) that t falls in, else of the last one; 1 without a schedule.

    schedule(clip, seg_idx, start_time, end_time, value) has boundaries within a step of the
    multiples of step, so that the interval with a time's own number, or a neighbour of it,
    holds it: an equi join on clip and number.
    """
    order = Window.partitionBy("clip").orderBy("seg_idx")
    last = F.max("seg_idx").over(Window.partitionBy("clip"))
    near = schedule.select("clip", F.col("seg_idx").alias("_i"), "start_time", "end_time", "value", F.lag("value").over(order).alias("_before"), F.lead("value").over(order).alias("_after"), last.alias("_last"))
    ends = near.where("_i = _last").select("clip", "_last")
    numbered = frames.join(ends, "clip", "left").withColumn("_i", F.least(F.floor(F.col("t") / step).cast("int"), F.col("_last"))).drop("_last")
    found = numbered.join(near, ["clip", "_i"], "left")
    speed = F.when(F.col("t") < F.col("start_time"), F.coalesce("_before", "value")).when(F.col("t") >= F.col("end_time"), F.coalesce("_after", "value")).otherwise(F.col("value"))
    return found.select(*frames.columns, F.coalesce(speed, F.lit(1.0)).alias("speed"))


def speed_at(t: Column, spans: list[tuple[float, float, float]], step: float) -> Column:
    """The speed of the interval [start, end) that a time falls in, else of the last one; 1 without intervals.

    For a few intervals that all clips share. The boundaries lie near multiples of step, so
    that one of three intervals around the time's own multiple holds it.
    """
    if not spans:
        return F.lit(1.0)
    table = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(v)).alias("v")) for a, b, v in spans])
    near = F.floor(t / step).cast("int")

    def held(shift: int) -> Column:
        place = near + shift
        s = F.when(place >= 0, F.get(table, F.greatest(F.lit(0), place)))
        return F.when((t >= s["a"]) & (t < s["b"]), s["v"])

    return F.coalesce(*[held(d) for d in (-1, 0, 1)], F.lit(float(spans[-1][2])))


def frame_map(frames: DataFrame, keys: list[str], fps: float, n: Column) -> DataFrame:
    """in_idx of each frame(…, out_idx, speed): the time run through at the frames' speeds.

    The first frame stands at 0; each later one moves on by its speed.
    """
    order = Window.partitionBy(*keys).orderBy("out_idx")
    moved = F.when(F.row_number().over(order) == 1, 0.0).otherwise(F.col("speed") / fps)
    run = frames.withColumn("_m", moved).withColumn("_t", F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.greatest(F.lit(0).cast("long"), F.least(F.rint(F.col("_t") * fps).cast("long"), n.cast("long") - 1))
    return run.withColumn("in_idx", place).drop("_m", "_t")


def repeat_previous(mapped: DataFrame, places: Column, keys: list[str]) -> DataFrame:
    """The map where the frames that a condition marks show the one before them; no two of them may be adjacent."""
    before = F.lag("in_idx").over(Window.partitionBy(*keys).orderBy("out_idx"))
    return mapped.withColumn("in_idx", F.when(places, F.coalesce(before, F.col("in_idx"))).otherwise(F.col("in_idx")))


def last_use(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """The last place at which each input frame is shown."""
    return mapped.groupBy(*keys, "in_idx").agg(F.max("out_idx").alias("last_out"))


def look_up(mapped: DataFrame, frames: DataFrame, keys: list[str], value: str, missing: float) -> DataFrame:
    """The map with the input frames' value, or missing where there is no such frame."""
    source = frames.select(*keys, F.col("frame_index").alias("in_idx"), value)
    return mapped.join(source, [*keys, "in_idx"], "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def look_up_or_last(mapped: DataFrame, frames: DataFrame, keys: list[str], value: str, missing: float) -> DataFrame:
    """The same, but a place beyond the last input frame shows that one; missing only where there is no frame at all."""
    last = frames.groupBy(*keys).agg(F.max("frame_index").alias("_last"))
    kept = mapped.join(last, keys, "left").withColumn("in_idx", F.least("in_idx", F.coalesce("_last", "in_idx"))).drop("_last")
    return look_up(kept, frames, keys, value, missing)


def fit_length(mapped: DataFrame, keys: list[str], n: Column, tolerance: float = 0.01) -> DataFrame:
    """Each map (keys, out_idx, in_idx) cut, or filled with its last row, where its length is off n by more than tolerance.

    n: the wanted length, the same on all rows of a map. The limits are truncated to whole numbers.
    """
    low, high = (n * F.lit(1 - tolerance)).cast("long"), (n * F.lit(1 + tolerance)).cast("long")
    sized = mapped.select(*keys, "out_idx", "in_idx", low.alias("_low"), high.alias("_high"))
    ends = sized.groupBy(*keys).agg(F.count("*").alias("_n"), F.max_by("in_idx", "out_idx").alias("_in"), F.max("_low").alias("_low"))
    lack = F.when(F.col("_n") < F.col("_low"), F.sequence(F.col("_n"), F.col("_low") - 1))
    return sized.where("out_idx < _high").select(*keys, "out_idx", "in_idx").unionByName(ends.select(*keys, F.explode(lack).alias("out_idx"), F.col("_in").alias("in_idx")))


def drift(schedule: DataFrame, width: int, height: int) -> DataFrame:
    """A schedule (seg_idx, start_time, end_time, dx, dy) with the offset reached at each start."""
    order = Window.partitionBy("stream_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    span = F.col("end_time") - F.col("start_time")
    return schedule.withColumns(
        {f"offset_{a}": F.coalesce(F.sum(MAX_DRIFT * side * F.col(f"d{a}") * span).over(order), F.lit(0.0)) for a, side in (("x", width), ("y", height))}
    )


def drift_at(t: Column, s: Column, width: int, height: int) -> tuple[Column, Column]:
    """Offset at t inside an interval of drift()."""
    gone = F.greatest(F.lit(0.0), F.least(t, s["end_time"]) - s["start_time"])
    return s["offset_x"] + MAX_DRIFT * width * s["dx"] * gone, s["offset_y"] + MAX_DRIFT * height * s["dy"] * gone


def build_map(clips: DataFrame, fps: float, schedule: DataFrame, step: float, jitter_s: float, repeat_percent: float, seed: int) -> DataFrame:
    """clip, out_idx and in_idx of clips(clip, n): jittered speeds, run through, some places repeated, length kept."""
    frames = clips.where("n > 0").select("clip", F.col("n").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("out_idx"))
    frames = frames.withColumn("t", F.col("out_idx") / fps)
    mapped = frame_map(speed_of(frames, jitter(schedule, jitter_s, seed), step), ["clip"], fps, F.col("n"))
    marked = repeated_places(mapped, repeat_percent, seed)
    return fit_length(repeat_previous(marked, F.col("repeats"), ["clip"]), ["clip"], F.col("n"))
