"""Time-varying parameters: schedules of contiguous intervals, and their value at any time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelattice import schemas
from cuelattice.functions import numeric as N


def intervals(duration: float, step: float) -> list[tuple[float, float]]:
    """Intervals of step seconds that cover duration; one if step is as long, none without duration."""
    if duration <= 0:
        return []
    if step >= duration:
        return [(0.0, duration)]
    n = math.ceil(duration / step)
    return [(i * step, min((i + 1) * step, duration)) for i in range(n)]


MODES = ("random", "sinusoidal", "correlated")


def drawn(clips: DataFrame, ranges: dict[str, tuple[float, float]], step: float, mode: str, frequency: float = 0.1, seed: int = 0) -> DataFrame:
    """Schedules of clips(clip, duration): clip, param, seg_idx, start_time, end_time and value for each range (low, high).

    random: a uniform value for each interval. sinusoidal: a wave of its own frequency
    (within a fifth of the given one) and phase, taken at the middle of each interval.
    correlated: a wave whose phase is within a twelfth of a turn of one that all parameters
    of a clip share, and whose frequency is within a tenth. Any other mode is random. A step
    as long as the clip makes one interval; a clip without duration has none. Draws are
    hashes of the seed, the clip and the parameter, so that rows are drawn where they are.
    """
    known = clips.where("duration > 0").select("clip", F.col("duration").cast("double").alias("duration"))
    last = F.when(F.lit(float(step)) >= F.col("duration"), 0).otherwise(F.ceil(F.col("duration") / step) - 1).cast("int")
    spans = known.select("*", F.explode(F.sequence(F.lit(0), last)).alias("seg_idx"))
    table = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for p, (a, b) in ranges.items()])
    rows = spans.select("*", F.inline(table)).withColumns({"start_time": F.col("seg_idx") * float(step), "end_time": F.least((F.col("seg_idx") + 1) * float(step), F.col("duration"))})
    if mode in ("sinusoidal", "correlated"):
        own = N.uniform(seed, "clip", "param", F.lit("frequency"))
        turn = N.uniform(seed, "clip", "param", F.lit("phase"))
        if mode == "sinusoidal":
            pace, phase = frequency * (0.8 + 0.4 * own), 2 * math.pi * turn
        else:
            pace, phase = frequency * (0.9 + 0.2 * own), 2 * math.pi * N.uniform(seed, "clip") + (2 * turn - 1) * (math.pi / 6)
        middle, swing = (F.col("low") + F.col("high")) / 2, (F.col("high") - F.col("low")) / 2
        wave = middle + swing * F.sin(2 * math.pi * pace * ((F.col("start_time") + F.col("end_time")) / 2) + phase)
        value = F.greatest("low", F.least("high", wave))
    else:
        value = F.col("low") + (F.col("high") - F.col("low")) * N.uniform(seed, "clip", "param", "seg_idx")
    return rows.select("clip", "param", "seg_idx", "start_time", "end_time", value.alias("value"))


def drift_directions(rows: DataFrame, seed: int, *parts: str) -> DataFrame:
    """The rows with a direction of drift (dx, dy) of a length from 0.3 to 1 each."""
    turn = 2 * math.pi * N.uniform(seed, *parts, F.lit("turn"))
    size = 0.3 + 0.7 * N.uniform(seed, *parts, F.lit("size"))
    return rows.withColumns({"dx": F.cos(turn) * size, "dy": F.sin(turn) * size})


def to_table(spark: SparkSession, schedules: dict[str, list[tuple[float, float, float]]]) -> DataFrame:
    """Schedules as a table (param, seg_idx, start_time, end_time, value)."""
    rows = [(name, i, *row) for name, rows in schedules.items() for i, row in enumerate(rows)]
    return spark.createDataFrame(rows, schemas.SCHEDULE)


def sinusoid(times: Column, low: float, high: float, frequency: float, phase: float) -> Column:
    """The wave of a sinusoidal schedule as an expression, kept between low and high."""
    middle, swing = (low + high) / 2, (high - low) / 2
    return F.greatest(F.lit(low), F.least(F.lit(high), middle + swing * F.sin(2 * math.pi * frequency * times + phase)))


def with_neighbours(schedule: DataFrame) -> DataFrame:
    """The schedule with the values before and after each interval (null at the ends)."""
    order = Window.partitionBy("param").orderBy("seg_idx")
    return schedule.withColumns({"before": F.lag("value").over(order), "after": F.lead("value").over(order)})


def value_at(t: Column, s: Column, window: float) -> Column:
    """Value at t of an interval struct with start_time, end_time, value, before and after.

    Constant, but for a linear passage of window seconds centred on each inner boundary;
    where two passages meet, that at the start counts.
    """
    half = window / 2

    def passage(edge: Column, a: Column, b: Column) -> Column:
        return a + (b - a) * ((t - (edge - half)) / window)

    def near(edge: Column) -> Column:
        return (t > edge - half) & (t < edge + half)

    start, end = s["start_time"], s["end_time"]
    return (
        F.when(s["before"].isNotNull() & near(start), passage(start, s["before"], s["value"]))
        .when(s["after"].isNotNull() & near(end), passage(end, s["value"], s["after"]))
        .otherwise(s["value"])
    )


def as_literal(rows: list[tuple[float, float, float]]) -> Column:
    """A schedule of up to some hundred intervals as an array of interval structs."""
    values = [v for _, _, v in rows]
    kind = "struct<start_time:double,end_time:double,value:double,before:double,after:double>"
    around = zip(rows, [None, *values[:-1]], [*values[1:], None], strict=True)
    return F.array(*[F.struct(*map(F.lit, (float(a), float(b), float(v), p, q))).cast(kind) for (a, b, v), p, q in around])


def lookup(t: Column, rows: list[tuple[float, float, float]], step: float, window: float) -> Column:
    """The value of a schedule drawn on the driver at any time, as an expression.

    The interval is found by its number, so there is neither a join nor a shuffle. Times
    before the first interval take its value, times after the last that one's; an empty
    schedule has the value 0.
    """
    if not rows:
        return F.lit(0.0)
    index = F.greatest(F.lit(0), F.least(F.floor(t / step).cast("int"), F.lit(len(rows) - 1)))
    found = F.transform(F.array(F.get(as_literal(rows), index)), lambda s: value_at(t, s, window))[0]
    return F.when(t <= rows[0][0], rows[0][2]).when(t >= rows[-1][1], rows[-1][2]).otherwise(found)


def sample(times: DataFrame, schedule: DataFrame, step: float, window: float, t: str = "t") -> DataFrame:
    """For each time and parameter the schedule's value: times' columns, param and value.

    Intervals of step seconds are found by an equi join on the number of the interval,
    not by comparing each time with each interval. Times before the first interval take
    its value, times after the last that one's. Without a schedule there is no row.
    """
    last = schedule.groupBy("param").agg(F.max("seg_idx").alias("_last"), F.max("end_time").alias("_until"))
    spans = F.struct("start_time", "end_time", "value", "before", "after").alias("_s")
    table = with_neighbours(schedule).select("param", F.col("seg_idx").alias("_i"), spans)
    params = F.broadcast(last.agg(F.collect_list(F.struct("param", "_last", "_until")).alias("_p")))  # one row, of a few parameters
    keyed = times.join(params).select(*times.columns, F.inline("_p"))
    index = F.greatest(F.lit(0), F.least(F.floor(F.col(t) / step).cast("int"), F.col("_last")))
    found = keyed.withColumn("_i", index).join(table, ["param", "_i"])
    edge = (F.col(t) <= 0) | (F.col(t) >= F.col("_until"))
    value = F.when(edge, F.col("_s.value")).otherwise(value_at(F.col(t), F.col("_s"), window))
    return found.select(*times.columns, "param", value.alias("value"))


def align(schedule: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """One row for each interval number with a column for each parameter, defaults where a schedule has none."""
    wide = schedule.groupBy("seg_idx").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *[F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in defaults]
    )
    return wide.select("seg_idx", "start_time", "end_time", *[F.coalesce(p, F.lit(float(v))).alias(p) for p, v in defaults.items()])
