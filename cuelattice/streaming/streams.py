"""Streaming forms: sessions, tumbling parameters and the tracker over a stream of detections."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from cuelattice.operators.tracking import COLUMNS, Settings, Tracker, entries_of
from cuelattice.sources.storage import ship_package


def read_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder)


def run_available(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there and return what it wrote.

    complete: the last state of the result; append and update: all that was put out. Each
    micro-batch is written under its number, so that one that is run again replaces itself.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    found = StructType([*stream.schema.fields, StructField("batch", LongType())])
    path = stream.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(stream.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return stream.sparkSession.createDataFrame([], stream.schema)  # no batch ran
    out = stream.sparkSession.read.schema(found).parquet(f"{folder}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch")
    return out.drop("batch")


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """Sessions of each key, as batch or stream: start, end of the last event, and number of events.

    An event exactly gap after the one before belongs to its session. The watermark ends
    a session's state once no event can reach it any more.
    """
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    own = timed.groupBy(*keys, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n"), F.max("_t").alias("last"))
    return own.select(*keys, F.col("w.start").alias("start"), "last", "n")


def tumbling(events: DataFrame, keys: list[str], time: str, width: str, value: str, late: str = "0 seconds") -> DataFrame:
    """Number and mean of the values of each window of a fixed width, as batch or stream."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(*keys, F.window("_t", width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")


def track_stream(detections: DataFrame, settings: Settings = Settings(), smooth: bool = True) -> DataFrame:
    """The tracker over a stream of detections(stream_id, frame_index, t, box, text, ends).

    Frames of a stream must come in order, all rows of a frame in one micro-batch; within a
    frame regions come in the order of the column place, if there is one, then of box and text. A
    segment is put out when it ends; a row with ends set closes all that are open. The
    state of a stream is its open segments, max_active at most.
    """
    ship_package(detections.sparkSession)
    place = ["place"] if "place" in detections.columns else []
    order = ["frame_index", *place, "x", "y", "width", "height", "text"]
    flat = detections.select("stream_id", "frame_index", "t", "box.x", "box.y", "box.width", "box.height", "text", "ends", *place)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(settings)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        ended = []
        for frame, group in rows[~rows["ends"]].groupby("frame_index", sort=True):
            ended += tracker.observe(int(frame), [(t, (int(x), int(y), int(w), int(h)), text or "") for t, x, y, w, h, text in group[["t", "x", "y", "width", "height", "text"]].itertuples(index=False)])
        if rows["ends"].any():
            ended += tracker.finish()
        state.update((pickle.dumps(tracker),))
        if ended:
            yield pd.DataFrame([r for s in ended for r in entries_of(key[0], s, smooth)], columns=names)

    return flat.groupBy("stream_id").applyInPandasWithState(run, COLUMNS, "tracker binary", "append", GroupStateTimeout.NoTimeout)


class ProgressLog(StreamingQueryListener):
    """Keeps (event, number of the batch, rows) of the streams of a session."""

    def __init__(self) -> None:
        self.events: list[tuple[str, int, int]] = []

    def onQueryStarted(self, event) -> None:
        self.events.append(("start", 0, 0))

    def onQueryProgress(self, event) -> None:
        self.events.append(("update", event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        self.events.append(("idle", 0, 0))

    def onQueryTerminated(self, event) -> None:
        self.events.append(("close", 0, 0))
