"""Subtitles: numbered cues in order of time, and SRT text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions import text as X


def cues(segments: DataFrame, keys: list[str], tiebreak: list[str], translations: DataFrame | None = None) -> DataFrame:
    """Numbered cues of segments(keys, …, start_time, end_time, canonical_text): cue, start_ts, end_ts, text.

    translations(segment_id, translated_text) replace the canonical text where there are any.
    """
    text: Column = F.col("canonical_text")
    if translations is not None:
        segments = segments.join(translations.select("segment_id", "translated_text"), "segment_id", "left")
        text = F.coalesce("translated_text", "canonical_text")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_time", *tiebreak))
    return segments.select(
        *keys, number.alias("cue"), X.srt_timestamp(F.col("start_time")).alias("start_ts"), X.srt_timestamp(F.col("end_time")).alias("end_ts"), text.alias("text")
    )


def srt(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """The SRT text of each stream: cues parted by empty lines, with a line feed at the end."""
    block = F.concat_ws("\n", F.col("cue").cast("string"), F.concat_ws(" --> ", "start_ts", "end_ts"), "text")
    ordered = F.sort_array(F.collect_list(F.struct("cue", block.alias("block"))))
    return numbered.groupBy(*keys).agg(F.concat(F.array_join(F.transform(ordered, lambda c: c["block"]), "\n\n"), F.lit("\n")).alias("srt"))


def frame_entries(frames: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Each frame with the entries shown on it; a frame without any comes once, with null entries."""
    return frames.join(entries, keys, "left")


def untouched_frames(frames: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Frames that no entry is shown on."""
    return frames.join(entries.select(*keys), keys, "left_anti")
