"""Segments of detections without a stateful tracker: gaps and islands, summaries, gap filling, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions import geometry as G
from cuelattice.functions import text as X


def islands(rows: DataFrame, keys: list[str], time: str, gap: float, tiebreak: str) -> DataFrame:
    """The rows with island, counting from 1: a gap above the limit opens a new one."""
    order = Window.partitionBy(*keys).orderBy(time, tiebreak)
    opens = F.when(F.col(time) - F.lag(time).over(order) <= gap, 0).otherwise(1)
    return rows.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def summarize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last frame and time, number of entries and canonical text of each segment."""
    return rows.groupBy(*keys).agg(
        F.min("frame_index").alias("start_frame"),
        F.max("frame_index").alias("end_frame"),
        F.min("t").alias("start_time"),
        F.max("t").alias("end_time"),
        F.count("*").alias("n_entries"),
        X.canonical(F.col("text"), F.col("frame_index")).alias("canonical_text"),
    )


def fill_gaps(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries for the missing frames between observed ones, interpolated.

    Box and time are interpolated; the text is the longer of the two neighbours', the
    earlier one's in a tie.
    """
    order = Window.partitionBy(*keys).orderBy("frame_index")
    after = F.lead(F.struct("frame_index", "t", "box", "text")).over(order)
    paired = entries.withColumn("_next", after)
    missing = F.when(F.col("_next.frame_index") > F.col("frame_index") + 1, F.sequence(F.col("frame_index") + 1, F.col("_next.frame_index") - 1))
    kept = paired.select(*keys, "frame_index", "t", "box", "text", F.lit(False).alias("interpolated"))
    share = (F.col("_f") - F.col("frame_index")) / (F.col("_next.frame_index") - F.col("frame_index"))
    made = paired.withColumn("_f", F.explode(missing)).select(
        *keys,
        F.col("_f").alias("frame_index"),
        (F.col("t") + (F.col("_next.t") - F.col("t")) * share).alias("t"),
        G.lerp(F.col("box"), F.col("_next.box"), share).alias("box"),
        F.when(F.length("_next.text") > F.length("text"), F.col("_next.text")).otherwise(F.col("text")).alias("text"),
        F.lit(True).alias("interpolated"),
    )
    return kept.unionByName(made)


def representative_boxes(entries: DataFrame, keys: list[str], limit: float = 0.3) -> DataFrame:
    """Smallest and median box by area, median sizes, and whether the sizes are steady.

    The median is element n // 2 of the sorted values. A size is steady if it varies by
    less than limit times its median. Entries are numbered in each order by windows over
    one partitioning, so that no segment is gathered into a row.
    """
    own = Window.partitionBy(*keys)
    half = F.floor(F.count("*").over(own) / 2) + 1
    orders = {"_a": (G.area(F.col("box")), "frame_index"), "_w": (F.col("box.width"),), "_h": (F.col("box.height"),)}
    placed = entries.select(*keys, "frame_index", "box", half.alias("_half"), *[F.row_number().over(own.orderBy(*o)).alias(c) for c, o in orders.items()])
    w, h = F.col("box.width"), F.col("box.height")

    def at(place: Column, value: Column) -> Column:
        return F.max(F.when(place, value))

    out = placed.groupBy(*keys).agg(
        at(F.col("_a") == 1, F.col("box")).alias("smallest"),
        at(F.col("_a") == F.col("_half"), F.col("box")).alias("middle"),
        at(F.col("_w") == F.col("_half"), w).alias("median_width"),
        at(F.col("_h") == F.col("_half"), h).alias("median_height"),
        (F.max(w) - F.min(w)).alias("dw"),
        (F.max(h) - F.min(h)).alias("dh"),
    )
    steady = (F.col("dw") < limit * F.col("median_width")) & (F.col("dh") < limit * F.col("median_height"))
    return out.select(*keys, "smallest", "middle", "median_width", "median_height", steady.alias("steady"))


def in_region(segments: DataFrame, region: Column | None) -> DataFrame:
    """Segments with entries whose first box has its centre in the region; a null region keeps all."""
    some = segments.where(F.size("entries") > 0)
    if region is None:
        return some
    first = F.get("entries", F.lit(0))["box"]
    return some.where(region.isNull() | G.contains(region, G.center_x(first), G.center_y(first)))


def with_suppression(entries: DataFrame, keys: list[str], region: Column) -> DataFrame:
    """Entries with rendered: false for all of a segment whose first box has its centre in the region.

    Such entries are still cleared from the picture, but no text is drawn on them. A null
    region suppresses nothing.
    """
    first = F.first("box").over(Window.partitionBy(*keys).orderBy("frame_index"))
    inside = G.contains(region, G.center_x(F.col("_first")), G.center_y(F.col("_first")))
    return entries.withColumn("_first", first).withColumn("rendered", region.isNull() | ~inside).drop("_first")


def nearest_observed(targets: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """targets(keys, frame_index) with the frame, text and box of the nearest entry, the earlier one of two, and t at the target.

    t is interpolated between the entries around the target; before the first and after the
    last entry it is that one's. A target whose segment has no entries is left out. One pass
    over each segment in order of frames, no comparison of each target with each entry.
    """
    seen = F.struct(F.col("frame_index").alias("f"), "t", "text", "box")
    kind = entries.select(seen.alias("e")).schema["e"].dataType.simpleString()
    both = targets.select(*keys, "frame_index", F.lit(None).cast(kind).alias("e"), F.lit(True).alias("asked")).unionByName(
        entries.select(*keys, "frame_index", seen.alias("e"), F.lit(False).alias("asked"))
    )
    order = Window.partitionBy(*keys).orderBy("frame_index", "asked")
    back = Window.partitionBy(*keys).orderBy(F.col("frame_index").desc(), "asked")
    before, after = F.last("e", True).over(order), F.last("e", True).over(back)
    found = both.withColumns({"_a": before, "_b": after}).where("asked AND (_a IS NOT NULL OR _b IS NOT NULL)")
    gap_a, gap_b = F.col("frame_index") - F.col("_a.f"), F.col("_b.f") - F.col("frame_index")
    near = F.when(F.col("_b").isNull() | (gap_a <= gap_b), F.col("_a")).otherwise(F.col("_b"))
    share = F.try_divide(gap_a.cast("double"), (F.col("_b.f") - F.col("_a.f")).cast("double"))
    t = F.coalesce(F.col("_a.t") + share * (F.col("_b.t") - F.col("_a.t")), F.col("_a.t"), F.col("_b.t"))
    return found.withColumns({"_n": near, "_t": t}).select(*keys, "frame_index", F.col("_n.f").alias("observed_frame"), F.col("_n.text").alias("text"), F.col("_n.box").alias("box"), F.col("_t").alias("t"))
