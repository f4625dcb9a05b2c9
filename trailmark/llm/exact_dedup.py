"""Exact dedup by skew-safe combining.

Copies are combined in three stages, and each stage compares the full normalised content, never a digest alone:

1. *locally*: the map side of the first aggregation collapses copies inside an input partition;
2. *per salt*: ``(salt, digest, content)`` groups meet, so a group holding a third of all rows is spread over
   ``salts`` tasks and each task sees at most one row per input partition of it;
3. *globally*: at most ``salts`` winners per content meet.

Decisions travel back along the same ladder: winners to salt winners, salt winners to rows, so no join key ever
carries more than one salt's share of a hot group.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import lower_ascii, unused


def _identity(content: Column) -> list[Column]:
    """What stands for a content after the contents themselves have been compared: 256 + 64 bits and the length."""
    return [F.unhex(F.sha2(content, 256)).alias("__digest"), F.xxhash64(content, F.octet_length(content)).alias("__mark")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z.  A null text is the empty text, so null and empty
    rows form one group.  The largest id of a group stays; null ids order below all others and a group of null
    ids only keeps its null.  Rows repeated with the same id share their flag.  An empty table gives an empty
    result; columns other than the two named are ignored.
    """
    if not 1 <= salts <= 64:
        raise ValueError("salts are kept as bits of one long: 1 to 64")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__content"),
    )
    rows = rows.select("doc_id", "__content", *_identity(F.col("__content")), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("__salt"))
    by_salt = rows.groupBy("__salt", "__digest", "__mark", "__content").agg(F.max("doc_id").alias("__keep"), F.count("*").alias("__n"))
    winners = (
        by_salt.groupBy("__digest", "__mark", "__content")
        .agg(F.max("__keep").alias("keep_id"), F.sum("__n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts"))
        .select("__digest", "__mark", "keep_id", "group_size", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> getbit(__salts, s) = 1)")).alias("__salt"))
    )
    return (
        rows.select("doc_id", "__digest", "__mark", "__salt")
        .join(winners, ["__digest", "__mark", "__salt"])
        .select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("__digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """``docs`` with one row per distinct normalised text, all columns as they came.

    Of rows repeated with the same id and text one stays; which one is open, since they are equal in both.  Null and
    empty texts are one text, so one such row stays.  An empty table stays empty, and columns may have any names.
    """
    own, kept_id, kept_sha, n = unused(docs, "__sha", "__kept_id", "__kept_sha", "__rows")
    flags = exact_groups(docs, id_col, text_col, salts).filter("kept").groupBy(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).agg(F.count("*").alias(n))
    content = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    tagged = docs.withColumn(own, F.sha2(content, 256))
    kept = tagged.join(flags, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_sha)))
    # Only rows that repeat with their id are looked at twice.
    several = kept.filter(F.col(n) > 1).dropDuplicates([id_col, own])
    return kept.filter(F.col(n) == 1).unionByName(several).select(*docs.columns)
