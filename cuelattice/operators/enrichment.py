"""Enrichment of texts by an outside service: each distinct text once, in batches, with fall-backs.

A provider is a function from a list of texts to a list of as many results; it may raise.
The service is a parameter, so that a job never depends on a network here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions import text as X
from cuelattice.sources.storage import allow_checkpoints, ship_package

Provider = Callable[[Sequence[str]], Sequence[str]]
TRANSLATED, PASSED, UNTRANSLATED = "translated", "passthrough", "untranslated"
_RESULT = "norm_text string, translated_text string, status string, error_message string"


def distinct_texts(segments: DataFrame, text: str, order: str) -> DataFrame:
    """norm_text and ord, its first place, for each distinct normalized text that is not empty."""
    norm = X.normalize(F.col(text)).alias("norm_text")
    return segments.select(norm, F.col(order).alias("ord")).where(F.length("norm_text") > 0).groupBy("norm_text").agg(F.min("ord").alias("ord"))


def batches(texts: DataFrame, size: int) -> DataFrame:
    """The texts with batch and place: size to a batch in order of ord, then text.

    The order is global but no task holds it: ranges of ord, fixed by a checkpoint, are
    numbered apart, and the counts of the ranges before are added.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    allow_checkpoints(spark)
    ship_package(spark)
    ranged = texts.repartitionByRange(parts, "ord", "norm_text").withColumn("_p", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("ord", "norm_text")) - 1
    numbered = ranged.withColumn("_i", own).join(F.broadcast(before), "_p").withColumn("_i", F.col("_i") + F.col("_b"))
    return numbered.select("norm_text", "ord", F.floor(F.col("_i") / size).cast("long").alias("batch"), (F.col("_i") % size).cast("int").alias("place"))


def prompts(batched: DataFrame, head: str = "", limit: int = 0, limit_line: str = "At most {} characters for each.\n") -> DataFrame:
    """One prompt for each batch: head, the limit if there is one, and the numbered texts."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "norm_text"))), lambda x: x["norm_text"])
    text = F.concat(F.lit(head + (limit_line.format(limit) if limit > 0 else "")), X.numbered(F.col("_t")))
    return batched.groupBy("batch").agg(ordered.alias("_t")).select("batch", F.size("_t").alias("n"), text.alias("prompt"))


def translate_batch(texts: Sequence[str], provider: Provider, fallback: Provider | None, attempts: int, pause: Callable[[float], None] = time.sleep) -> list[tuple[str, str, str, str | None]]:
    """(norm_text, translated_text, status, error_message) of each text of a batch.

    A call that raises is tried again after 1, 2, 4 … seconds. If all attempts fail, or the number of results is
    wrong, each text goes to the fall-back by itself; so does a text whose result is
    blank. What fails there too keeps its text and says why.
    """
    def alone(text: str, why: str | None) -> tuple[str, str, str, str | None]:
        try:
            if fallback is None:
                raise RuntimeError(why or "no fallback")
            found = fallback([text])[0].strip()
            if not found:
                raise RuntimeError("empty result")
            return text, found, TRANSLATED, None
        except Exception as e:  # noqa: BLE001  whatever a provider raises becomes a status
            return text, text, UNTRANSLATED, str(e)

    why = None
    for attempt in range(attempts):
        try:
            found = provider(texts)
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {e}"
            if attempt + 1 < attempts:
                pause(2.0**attempt)
            continue
        if len(found) != len(texts):
            why = "wrong number of results"
            break
        return [(t, r.strip(), TRANSLATED, None) if r.strip() else alone(t, "empty result") for t, r in zip(texts, found, strict=True)]
    return [alone(t, why) for t in texts]


def enrich(segments: DataFrame, text: str, order: str, provider: Provider, fallback: Provider | None = None, cache: DataFrame | None = None, size: int = 10, attempts: int = 4, max_chars: int = 0, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """The segments with translated_text, status and error_message.

    Blank texts pass through. A text longer than max_chars (0: no limit) stays
    untranslated. cache(norm_text, translated_text, status) answers texts that it holds
    as translated or passed; those it holds as untranslated are asked for again.
    """
    texts = distinct_texts(segments, text, order)
    known = None
    if cache is not None:
        known = cache.where(F.col("status").isin(TRANSLATED, PASSED)).select("norm_text", "translated_text", "status", F.lit(None).cast("string").alias("error_message"))
        texts = texts.join(known.select("norm_text"), "norm_text", "left_anti")
    long = None
    if max_chars > 0:
        long = texts.where(F.length("norm_text") > max_chars).select("norm_text", F.col("norm_text").alias("translated_text"), F.lit(UNTRANSLATED).alias("status"), F.lit("text too long").alias("error_message"))
        texts = texts.where(F.length("norm_text") <= max_chars)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RESULT.split(", ")]
        for part in rows:
            for group in part["texts"]:
                yield pd.DataFrame(translate_batch(list(group), provider, fallback, attempts, pause), columns=names)

    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "norm_text"))), lambda x: x["norm_text"])
    answers = batches(texts, size).groupBy("batch").agg(ordered.alias("texts")).select("texts").mapInPandas(run, _RESULT)
    for more in (known, long):
        if more is not None:
            answers = answers.unionByName(more)
    keyed = segments.withColumn("norm_text", X.normalize(F.col(text)))
    out = keyed.join(answers, "norm_text", "left")
    blank = F.length("norm_text") == 0
    return out.withColumns(
        {
            "translated_text": F.when(blank, F.col(text)).otherwise(F.col("translated_text")),
            "status": F.when(blank, F.lit(PASSED)).otherwise(F.col("status")),
        }
    ).drop("norm_text")


def calls_in_window(calls: DataFrame, keys: list[str], seconds: str, window: float, limit: int) -> DataFrame:
    """Each call with the number of calls of its key in the window before and with it, and whether it is above the limit."""
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-window, 0)
    return calls.withColumn("in_window", F.count("*").over(w)).withColumn("throttled", F.col("in_window") > limit)
