"""Tables of the engine's model, derived from event and embedding tables.

frames: one row for each event of a user, numbered by time, as frames of a stream.
detections: the same with a box, a text and a confidence each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelattice.functions import geometry as G

FRAME_WIDTH, FRAME_HEIGHT = 1920, 1080


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame_index, t (seconds from the stream's start), event_id, event_type, value."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("stream_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value"
    )
    own = Window.partitionBy("stream_id")
    order = own.orderBy("us", "event_id")
    return events.select(
        "stream_id",
        (F.row_number().over(order) - 1).cast("long").alias("frame_index"),
        ((F.col("us") - F.min("us").over(own)) / 1e6).alias("t"),
        "event_id",
        "event_type",
        "value",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames with box, text and confidence made from event_id by whole-number arithmetic."""
    i = F.col("event_id")
    b = G.box((i * 13) % 1600, (i * 7) % 900, 20 + i % 200, 10 + i % 60)
    return frames(spark, sf_dir).select(
        "stream_id", "frame_index", "t", "event_id", F.col("event_type").alias("text"), ((i * 37) % 1000 / 1000.0).alias("confidence"), b.alias("box")
    )


def regions(spark: SparkSession, sf_dir: str, each: int = 3) -> DataFrame:
    """Detections with several regions to a frame: some consecutive events of a user are one frame.

    place is the region's number in its frame. Boxes move little between frames and texts
    repeat, within a frame too, so that regions compete for segments.
    """
    i = F.col("event_id")
    b = G.box((F.col("place") * 400 + (i * 13) % 90).cast("int"), ((i * 7) % 40 + 100 * (i % 2)).cast("int"), (150 + i % 20).cast("int"), (40 + i % 6).cast("int"))
    rows = frames(spark, sf_dir).withColumns({"place": F.col("frame_index") % each, "frame_index": F.floor(F.col("frame_index") / each).cast("long")})
    text = F.concat_ws(" ", "event_type", F.when(i % 5 == 0, "now"))
    return rows.select("stream_id", "frame_index", "place", "t", "event_id", text.alias("text"), ((i * 37) % 1000 / 1000.0).alias("confidence"), b.alias("box"))


def timeline(spark: SparkSession, sf_dir: str, fps: float = 30.0) -> DataFrame:
    """out_idx and t of the frames of a clip, one for each row of orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("out_idx"), (F.col("o_orderkey") / fps).alias("t"))
