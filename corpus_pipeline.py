"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir). run() writes what a stage returns as
Parquet in the shared folder of the session and reads it again for the next one, so that
an executor that is lost costs a stage some tasks and never an earlier stage. What a stage
read is deleted once the next one has written; the last stage's rows stay.

Rows are told apart by all their columns, never by doc_id alone: rows without an id, or with
one that other rows have, are documents of their own. Every stage takes null texts and
sources, repeated rows, empty tables and further columns of any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelattice.llm import mixing, pieces, simhash, substring, toxicity
from cuelattice.llm.common import prepare, read
from cuelattice.sources.storage import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects; a null text is an empty one."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, one without an id last."""
    return simhash.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller doc_id has are cut out; rows without an id stay as they are."""
    return substring.cut_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, not at all to twice; a null source is one."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; a null text has none."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

# The stages learn and draw at random, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), ""
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
