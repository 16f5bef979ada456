"""Schemas of the engine's tables, and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.IntegerType(), False) for c in ("x", "y", "width", "height")])


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


DETECTIONS = _table(video_id=T.StringType(), frame_index=T.IntegerType(), t=T.DoubleType(), box=BOX, text=T.StringType(), confidence=T.DoubleType())
ENTRIES = _table(video_id=T.StringType(), segment_id=T.StringType(), frame_index=T.IntegerType(), t=T.DoubleType(), box=BOX, text=T.StringType(), interpolated=T.BooleanType())
SCHEDULE = _table(param=T.StringType(), seg_idx=T.IntegerType(), start_time=T.DoubleType(), end_time=T.DoubleType(), value=T.DoubleType())
SCENES = _table(start_frame=T.LongType(), end_frame=T.LongType(), start_time=T.DoubleType(), end_time=T.DoubleType(), is_micro=T.BooleanType())
TRANSLATIONS = _table(source_text=T.StringType(), translated_text=T.StringType(), status=T.StringType(), error_message=T.StringType())


def detection_rules() -> dict[str, Column]:
    """Name and condition of each rule that a detection must meet."""
    b = F.col("box")
    return {
        "box size": (b["width"] > 0) & (b["height"] > 0),
        "box place": (b["x"] >= 0) & (b["y"] >= 0),
        "confidence": F.col("confidence").between(0.0, 1.0),
        "frame index": F.col("frame_index") >= 0,
        "time": F.col("t") >= 0,
    }


def validate(rows: DataFrame, rules: dict[str, Column], strict: bool = False) -> DataFrame:
    """The rows with an array of the rules that each violates; a null counts as a violation.

    strict: the first row that violates one is an error.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    out = rows.withColumn("violations", broken)
    if strict:
        first = F.raise_error(F.concat(F.lit("invalid row: "), F.array_join("violations", ", "))).cast("array<string>")
        out = out.withColumn("violations", F.when(F.size("violations") > 0, first).otherwise(F.col("violations")))
    return out
