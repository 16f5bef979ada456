"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.sources.storage import allow_checkpoints, ship_package

ARROW_BATCH, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512  # rows in an Arrow batch to Python: whole texts are long


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, the package on the executors, and a checkpoint folder where the session has none.

    A cluster names its shared folder in spark.checkpoint.dir; a folder of this machine
    is used only where that is unset, as in tests. The size of batches is the session's,
    which plans read when they run, so it is set there; one that the caller has chosen stays.
    """
    if spark.conf.get(ARROW_BATCH) == "10000":  # Spark's own
        spark.conf.set(ARROW_BATCH, str(ARROW_ROWS))
    allow_checkpoints(spark)
    ship_package(spark)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column | str, modulus: int, value: int) -> Column:
    """Whether a document is kept from training; false for a null id."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def labelled_sample(labels: DataFrame, column: str, slots: dict[int, int]) -> DataFrame:
    """(label, slot, doc_id, n): one document for each label (1 if column is above 0) and slot.

    Labelled documents are dealt into slots by a hash of their id; the one with the
    smallest hash stands for the n of its slot. A document with several labels has the
    largest; null ids and labels are left out. The result has as many rows as there are
    slots at most, at any size of the input, so it may be broadcast to the documents,
    whose texts then need no shuffle.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max((F.col(column) > 0).cast("int")).alias("label"))
    slot = F.pmod(F.xxhash64("doc_id"), F.when(F.col("label") == 1, slots[1]).otherwise(slots[0]))
    chosen = F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id"))
    dealt = known.groupBy("label", slot.alias("slot")).agg(chosen.alias("c"), F.count("*").alias("n"))
    return dealt.select("label", "slot", "c.doc_id", "n")
