"""From raw recognition results to detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions import geometry as G
from cuelattice.functions import text as X


def unpack(raw: DataFrame, scale_x: float, scale_y: float, frame_w: int, frame_h: int, min_confidence: float, ranges: tuple = X.CJK) -> DataFrame:
    """One row for each usable result of raw(…, texts, scores, polys), three arrays of one frame.

    Arrays of unequal length or null make no rows. Results whose score is no number or
    below min_confidence, whose text is empty or has no code point in ranges, or whose
    polygon covers nothing inside the frame are left out.
    """
    even = F.size("texts").isNotNull() & (F.size("texts") == F.size("scores")) & (F.size("texts") == F.size("polys"))
    keys = [c for c in raw.columns if c not in ("texts", "scores", "polys")]
    rows = raw.where(even & (F.size("texts") > 0)).select(*keys, F.posexplode(F.arrays_zip("texts", "scores", "polys")).alias("region", "r"))
    size = (F.lit(frame_w), F.lit(frame_h))
    rows = rows.select(
        *keys,
        "region",
        F.coalesce("r.texts", F.lit("")).alias("text"),
        X.confidence(F.col("r.scores")).alias("confidence"),
        G.polygon_box(F.col("r.polys"), F.lit(scale_x), F.lit(scale_y), *size).alias("box"),
    )
    return usable(rows, min_confidence, ranges).where("box IS NOT NULL")


def usable(rows: DataFrame, min_confidence: float, ranges: tuple | None = X.CJK) -> DataFrame:
    """Rows of enough confidence, with a text and a box that are not empty."""
    keep = (F.col("confidence") >= min_confidence) & (F.length(X.normalize(F.col("text"))) > 0) & (F.col("box.width") > 0) & (F.col("box.height") > 0)
    return rows.where(keep & X.has_script(F.col("text"), ranges) if ranges else keep)


def stride(frames: DataFrame, every: int) -> DataFrame:
    """Every so many frames of a stream, and its last one.

    The last frame is looked up by a window over the stream, which needs no shuffle where
    the frames are dealt by stream already, as they are once they have been numbered.
    """
    last = F.max("frame_index").over(Window.partitionBy("stream_id"))
    marked = frames.withColumn("_last", last).where((F.col("frame_index") % every == 0) | (F.col("frame_index") == F.col("_last")))
    return marked.drop("_last")


def adjacent_matches(rows: DataFrame, min_iou: float, min_similarity: float, near: float, diagonal: float, floor: float = 0.3) -> DataFrame:
    """Pairs of detections in consecutive frames of a stream that may be one text.

    An equi join on stream and frame with the rest as a residual condition: boxes that
    overlap and texts that are not too different, or equal enough texts nearby. score is
    overlap + similarity - distance / diagonal.
    """
    a = rows.select("stream_id", "frame_index", F.col("event_id").alias("a_id"), F.col("box").alias("a_box"), F.col("text").alias("a_text"))
    b = rows.select("stream_id", (F.col("frame_index") - 1).alias("frame_index"), F.col("event_id").alias("b_id"), F.col("box").alias("b_box"), F.col("text").alias("b_text"))
    pair = a.join(b, ["stream_id", "frame_index"])
    over, like = G.iou(F.col("a_box"), F.col("b_box")), X.similarity(F.col("a_text"), F.col("b_text"))
    pair = pair.withColumns({"iou": over, "similarity": like, "distance": G.center_distance(F.col("a_box"), F.col("b_box"))})
    match = ((F.col("iou") >= min_iou) & (F.col("similarity") >= floor)) | ((F.col("similarity") >= min_similarity) & (F.col("distance") <= near * diagonal))
    return pair.where(match).withColumn("score", F.col("iou") + F.col("similarity") - F.col("distance") / diagonal)


def coverage(rows: DataFrame, cell: int, padding: int, frame_w: int, frame_h: int) -> DataFrame:
    """Cells of cell x cell pixels of each stream that the padded boxes touch, each once."""
    b = F.col("box")
    edges = rows.select(
        "stream_id",
        F.greatest(F.lit(0), b["x"] - padding).alias("x1"),
        F.greatest(F.lit(0), b["y"] - padding).alias("y1"),
        F.least(F.lit(frame_w), G.right(b) + padding).alias("x2"),
        F.least(F.lit(frame_h), G.bottom(b) + padding).alias("y2"),
    ).where("x2 > x1 AND y2 > y1")

    def cells(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))

    return edges.select("stream_id", F.explode(cells("x1", "x2")).alias("cx"), "y1", "y2").select("stream_id", "cx", F.explode(cells("y1", "y2")).alias("cy")).distinct()
