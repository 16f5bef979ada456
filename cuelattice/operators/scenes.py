"""Scenes: cuts between unlike histograms, intervals between cuts, overlaps and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions import numeric as N

BINS, SPANS = (50, 60), (180.0, 256.0)  # of hue and saturation


def histogram(pixels: DataFrame, keys: list[str], a: str, b: str, bins: tuple[int, int] = BINS, spans: tuple[float, float] = SPANS) -> DataFrame:
    """Count of each pair of bins, and its share of the Euclidean length of all counts of a frame."""
    cell = [F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c) / (span / n)).cast("int"))) for c, n, span in zip((a, b), bins, spans, strict=True)]
    counts = pixels.groupBy(*keys, cell[0].alias("bin_a"), cell[1].alias("bin_b")).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.pow("n", F.lit(2.0))).over(Window.partitionBy(*keys)))
    return counts.withColumn("share", F.col("n") / length)


def differences(frames: DataFrame, keys: list[str], order: str, hist: str) -> DataFrame:
    """1 - correlation of each frame's histogram with that of the one before in its clip; null for the first."""
    paired = frames.withColumn("_h", F.lag(hist).over(Window.partitionBy(*keys).orderBy(order)))
    return paired.withColumn("diff", F.when(F.col("_h").isNotNull(), 1 - N.correlation(F.col("_h"), F.col(hist)))).drop("_h")


def boundaries(frames: DataFrame, keys: list[str], order: str, hist: str, threshold: float) -> DataFrame:
    """The frames whose difference is above the threshold."""
    return differences(frames, keys, order, hist).where(F.col("diff") > threshold)


def scenes(cuts: DataFrame, totals: DataFrame, keys: list[str], fps: float, max_micro: float) -> DataFrame:
    """Intervals of frames between cuts (keys, frame_index), from 0 to n_frames of totals(keys, n_frames).

    Empty intervals are left out; is_micro marks those shorter than max_micro seconds.
    """
    starts = cuts.select(*keys, F.col("frame_index").cast("long").alias("start_frame")).unionByName(totals.where("n_frames > 0").select(*keys, F.lit(0).cast("long").alias("start_frame")))
    order = Window.partitionBy(*keys).orderBy("start_frame")
    spans = starts.join(totals, keys).withColumn("end_frame", F.coalesce(F.lead("start_frame").over(order), F.col("n_frames").cast("long")))
    spans = spans.where("end_frame > start_frame").withColumns({"start_time": F.col("start_frame") / fps, "end_time": F.col("end_frame") / fps})
    return spans.select(*keys, "start_frame", "end_frame", "start_time", "end_time", ((F.col("end_time") - F.col("start_time")) < max_micro).alias("is_micro"))


def overlaps(found: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Scenes that begin earlier by half a transition, which is no longer than either neighbour."""
    order = Window.partitionBy(*keys).orderBy("start_frame")
    own = F.col("end_time") - F.col("start_time")
    before = F.lag(own).over(order)
    shift = F.coalesce(F.least(F.lit(seconds), before, own) / 2, F.lit(0.0))
    rate = F.when((own > 0) & (F.col("end_frame") > F.col("start_frame")), (F.col("end_frame") - F.col("start_frame")) / own).otherwise(30.0)
    out = found.withColumns({"_s": shift, "_first": before.isNull(), "_rate": rate})
    at = F.col("start_time") - F.col("_s")
    frame = F.when(F.col("_first"), F.col("start_frame")).otherwise(F.greatest(F.lit(0).cast("long"), F.rint(at * F.col("_rate")).cast("long")))
    moved = out.withColumns({"_f": frame, "_t": F.greatest(F.lit(0.0), at)})
    return moved.select(*keys, F.col("_f").alias("start_frame"), "end_frame", F.col("_t").alias("start_time"), "end_time", "is_micro")


def reorder(found: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """The scenes with place: each clip's short ones in another order, at the places that short ones have.

    The order is that of a hash of seed, clip and start. Where that is the old one, each
    short scene moves on by one, so that two or more never stay as they are.
    """
    clip = Window.partitionBy(*keys)
    place = found.withColumn("place", F.row_number().over(clip.orderBy("start_frame")))
    short = Window.partitionBy(*keys, "is_micro")
    nth = F.row_number().over(short.orderBy("place"))
    drawn = F.row_number().over(short.orderBy(N.uniform(seed, *keys, "start_frame"), "start_frame"))
    numbered = place.withColumns({"_nth": nth, "_to": drawn})
    same = F.min(F.col("_nth") == F.col("_to")).over(short)
    numbered = numbered.withColumn("_to", F.when(same, F.col("_nth") % F.count("*").over(short) + 1).otherwise(F.col("_to")))
    moves = numbered.where("is_micro")
    targets = moves.select(*keys, F.col("_nth").alias("_to"), F.col("place").alias("_place"))
    moved = moves.join(targets, [*keys, "_to"]).select(*found.columns, F.col("_place").alias("place"))
    return numbered.where("NOT is_micro").select(*found.columns, "place").unionByName(moved)


def frames_of(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each frame of each scene."""
    return found.where("end_frame > start_frame").select(*keys, "start_frame", F.explode(F.sequence(F.col("start_frame"), F.col("end_frame") - 1)).alias("frame_index"))
