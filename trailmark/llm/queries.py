"""Registered queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import table
from trailmark.llm.exact_dedup import exact_groups
from trailmark.llm.fuzzy_hash import compare_with_next
from trailmark.llm.kd_shards import kd_shards
from trailmark.llm.language_id import identify, learn_profiles
from trailmark.llm.license_scan import scan_licenses
from trailmark.llm.minhash import near_duplicates
from trailmark.llm.mixture import mix_sources
from trailmark.llm.packing import pack_documents
from trailmark.llm.suffix_dedup import remove_repeats
from trailmark.llm.toxicity import score_toxicity


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400).drop("spans")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op2_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter((_remainder(4) != 2) & F.col("lang").isNotNull()))
    held_out = (_remainder(4) == 2).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), profiles).drop("text")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=8)


def op4_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(_remainder(5) != 0)
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), target_entropy=0.95, max_repeats=4.0)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_rank_order_language": op2_rank_order_language,
    "op3_kd_shards": op3_kd_shards,
    "op4_piecewise_fingerprints": op4_piecewise_fingerprints,
    "op5_kneser_ney_toxicity": op5_kneser_ney_toxicity,
    "op6_source_mixture": op6_source_mixture,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_license_templates": op8_license_templates,
    "op9_sum_of_squares_packing": op9_sum_of_squares_packing,
    "op10_exact_dedup": op10_exact_dedup,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_ASCII_LOWER} AS content FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY content) AS keep_id,
               CAST(count(*) OVER (PARTITION BY content) AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY content) AS kept,
               sha256(content) AS text_sha256
        FROM d
    """,
}
