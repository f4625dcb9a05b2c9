"""Mixing sources to target weights: temperature, then budgeted block permutations.

Token shares are raised to an exponent between 0 (all sources equal) and 1 (as they come).  The exponent is
bisected on the driver over one number per source: the largest that reaches the target entropy, raised again
where a source would otherwise be repeated more often than allowed.  Weights become token budgets.  A source
whose budget is e epochs and a rest gives each document e copies; the rest goes to whole blocks of a keyed
permutation of its blocks, and the block that straddles the budget is filled document by document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import unused


def entropy(shares: list[float], exponent: float) -> float:
    """Of the normalised powers, in nats."""
    powers = [s**exponent for s in shares if s > 0]
    z = sum(powers)
    return -sum(p / z * math.log(p / z) for p in powers)


def repetition(shares: list[float], exponent: float, budget_share: float) -> float:
    """How often the most repeated source is read."""
    powers = [s**exponent for s in shares if s > 0]
    z = sum(powers)
    return max(p / z / s for p, s in zip(powers, [s for s in shares if s > 0], strict=True)) * budget_share


def find_exponent(shares: list[float], target_entropy: float, max_repeats: float, budget_share: float = 1.0, rounds: int = 60) -> float:
    """``target_entropy`` is a fraction of the entropy of equal weights.

    Entropy falls and repetition falls as the exponent goes to 1, so both conditions are bisected.  The
    repetition limit wins where the two disagree; where even exponent 1 repeats more, 1 is the answer.
    """
    shares = [s for s in shares if s > 0]
    if len(shares) < 2:
        return 1.0

    def last(holds) -> float:
        lo, hi = 0.0, 1.0
        if holds(hi):
            return hi
        for _ in range(rounds):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    goal = target_entropy * math.log(len(shares))
    by_entropy = last(lambda a: entropy(shares, a) >= goal)
    too_often = last(lambda a: repetition(shares, a, budget_share) > max_repeats) if repetition(shares, 0.0, budget_share) > max_repeats else 0.0
    return max(by_entropy, min(1.0, too_often + 2.0**-50 if too_often else 0.0))


def mix_sources(
    docs: DataFrame, target_entropy: float = 0.95, max_repeats: float = 4.0, budget_tokens: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = 4096, max_sources: int = 100_000
) -> DataFrame:
    """One row per input row: ``doc_id, source, tokens, weight, block, copies``.

    Tokens are taken as a quarter of the UTF-8 bytes, rounded up, and one to end the document, so null and empty
    texts count 1.  A null source is a source of its own.  The budget is all tokens unless given.  Repeated rows
    are rows of their own, each with its own place in the permutation of its block (equal rows: any order of
    them gives the same result).  An empty table gives an empty result.  More than ``max_sources`` sources are
    refused: only per-source sums reach the driver.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.ceil(F.octet_length(text) / 4) + 1).cast("long").alias("tokens"),
    )
    by_source = rows.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("n"))
    sums = by_source.limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    total = sum(r["source_tokens"] for r in sums)
    budget = budget_tokens or total
    shares = [r["source_tokens"] / total for r in sums]
    exponent = find_exponent(shares, target_entropy, max_repeats, budget / total if total else 1.0)
    z = sum(s**exponent for s in shares) or 1.0
    blocks = max(1, -(-sum(r["n"] for r in sums) // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)))
    share = F.col("source_tokens") / F.lit(float(total or 1))
    quotas = by_source.select(
        F.col("source").alias("of_source"),
        "source_tokens",
        (F.pow(share, F.lit(exponent)) / F.lit(z)).alias("weight"),
    ).withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) + 0.5)).select(
        "of_source",
        "weight",
        F.floor(F.col("quota") / F.col("source_tokens")).alias("epochs"),
        (F.col("quota") - F.floor(F.col("quota") / F.col("source_tokens")) * F.col("source_tokens")).alias("rest"),
    )
    in_order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    sized = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    sized = sized.withColumn("upto", F.sum("block_tokens").over(in_order)).join(quotas, F.col("source").eqNullSafe(F.col("of_source")))
    sized = sized.select(
        F.col("source").alias("of_source"), F.col("block").alias("of_block"), "weight", "epochs",
        (F.col("rest") - F.col("upto") + F.col("block_tokens")).alias("left"), "block_tokens",
    )
    joined = rows.join(sized, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("block") == F.col("of_block")))
    straddles = (F.col("left") > 0) & (F.col("left") < F.col("block_tokens"))
    base = ["doc_id", "source", "tokens", "weight", "block"]
    whole = joined.filter(~straddles).select(*base, (F.col("epochs") + (F.col("left") >= F.col("block_tokens")).cast("long")).alias("copies"))
    in_block = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    parted = joined.filter(straddles).withColumn("cum", F.sum("tokens").over(in_block))
    parted = parted.select(*base, (F.col("epochs") + (F.col("cum") <= F.col("left")).cast("long")).alias("copies"))
    return whole.unionByName(parted).withColumn("copies", F.col("copies").cast("int"))


def mixed(docs: DataFrame, target_entropy: float = 0.95, max_repeats: float = 4.0, budget_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with every row as often as the mixture asks, all columns as they came.

    Rows meet their decision on id, source and tokens, so repeated rows get the copies of each of them.  Null ids,
    sources and texts take part like others, an empty table stays empty, and columns may have any names.
    """
    own, source, tokens, copies, copy = unused(docs, "__id", "__source", "__tokens", "__copies", "__copy")
    plan = mix_sources(docs, target_entropy, max_repeats, budget_tokens, seed)
    once = plan.groupBy("doc_id", "source", "tokens").agg(F.max("copies")).toDF(own, source, tokens, copies)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(source)) & ((F.ceil(F.octet_length(text) / 4) + 1) == F.col(tokens))
    joined = docs.join(once.filter(F.col(copies) > 0), on)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
