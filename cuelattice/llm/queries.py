"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm import chat, langid, lm, media, mixing, pieces, quality, simhash, substring, toxicity
from cuelattice.llm.common import read


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(read(spark, sf_dir, "documents"), with_media=False)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxh64"), "round_trip", "parity")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(read(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(read(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_audio_features,
        op2_lm_scoring,
        op3_mix_sources,
        op4_toxicity,
        op5_sentencepiece,
        op6_substring_dedup,
        op7_quality_rules,
        op8_simhash_near_dedup,
        op9_language_id,
        op10_chat_formatting,
    )
}

# The other operators learn, draw at random or hash in ways that SQL does not have.
SQL: dict[str, str] = {
    "op6_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 50), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(0, greatest(0, len(ws) - 49))) AS i FROM w) a),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT win.doc_id, win.i FROM win JOIN firsts ON win.k = firsts.k WHERE f < win.doc_id) g),
word AS (SELECT doc_id, unnest(range(0, len(ws))) AS p, unnest(ws) AS t FROM w),
kept AS (SELECT word.doc_id, string_agg(t, ' ' ORDER BY word.p) AS s FROM word LEFT JOIN cov ON word.doc_id = cov.doc_id AND word.p = cov.p WHERE cov.p IS NULL GROUP BY word.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT w.doc_id, len(ws)::bigint AS n_words, coalesce(gone.n, 0)::bigint AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id""",
}
