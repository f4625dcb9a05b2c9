"""Turns with what followed them (T6, A4), per trajectory (A26) and per batch (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.stats import quantiles
from trailmark.operators.steps import duration_seconds, is_user_message

EDITING = ("edit", "create", "delete", "notebook")
VERIFYING = ("test", "build")
SIDE_EFFECTS = ("destructive", "remote")


def turn_summary(steps: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per turn: counts, duration, first and last act and how it ended.

    Interruption (a notice after the last action, or an interrupted last action) goes before a question, a question
    before a response, and a turn that ends otherwise ended in a tool.  A step's turn is a running count, and an
    action brings its own (from 1), so nothing is joined by intervals.
    """
    upto = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    numbered = steps.withColumn("index", F.sum(is_user_message().cast("long")).over(upto) - 1).filter("`index` >= 0")
    own_steps = numbered.withColumn("start", F.min("step").over(Window.partitionBy("key", "index")))
    talk = (F.col("role") == "assistant") & (F.col("kind") == "message")
    by_step = own_steps.groupBy("key", "index", "start").agg(
        F.max("step").alias("last_step"),
        F.max(F.when(F.col("step") == F.col("start"), F.length("content"))).cast("long").alias("prompt_chars"),
        F.count_if(F.col("kind") == "notice").alias("notices"),
        F.count("*").alias("steps"),
        F.count_if(talk).alias("messages"),
        F.count_if(F.col("kind") == "tool_call").alias("calls"),
        duration_seconds().alias("duration_s"),
        F.max(F.when((F.col("kind") == "notice") & (F.col("name") == "interruption"), F.col("step"))).alias("last_interruption"),
        F.max_by(talk, "step").alias("ends_with_message"),
    )
    nxt = F.lead("start").over(Window.partitionBy("key").orderBy("index"))
    by_step = by_step.withColumn("end", F.coalesce(nxt - 1, F.col("last_step"))).drop("last_step")
    own_actions = actions.filter("turn > 0").withColumn("index", F.col("turn").cast("long") - 1)
    at = F.struct("call", "ordinal")
    by_action = own_actions.groupBy("key", "index").agg(
        F.count("*").alias("actions"),
        F.count_if(F.col("act").isin(*EDITING)).alias("edits"),
        F.count_if(F.col("act").isin(*VERIFYING)).alias("verifications"),
        F.count_if(F.col("act") == "ask").alias("asks"),
        F.count_if(F.col("act") == "plan").alias("plans"),
        F.count_if(F.col("effect").isin(*SIDE_EFFECTS)).alias("side_effects"),
        F.count_if((F.col("ordinal") == 0) & (F.col("outcome") == "error")).alias("failed_calls"),
        F.count_if(F.col("act") == "delegate").alias("delegations"),
        F.min_by("act", at).alias("first_act"),
        F.max_by("act", at).alias("last_act"),
        F.max_by(F.coalesce("program", F.lower("tool")), at).alias("last_program"),
        F.max("call").alias("last_call"),
        F.max_by("outcome", at).alias("last_outcome"),
    )
    joined = by_step.join(by_action, ["key", "index"], "left")
    interrupted = F.coalesce(F.col("last_interruption") > F.coalesce("last_call", "start"), F.lit(False)) | F.coalesce(F.col("last_outcome") == "interrupted", F.lit(False))
    ended = F.when(interrupted, "interrupt").when(F.col("last_act") == "ask", "ask").when(F.col("ends_with_message"), "response").otherwise("tool")
    counts = ["actions", "edits", "verifications", "asks", "plans", "side_effects", "failed_calls", "delegations"]
    return joined.select(
        "key", "index", "start", "end", "prompt_chars", "notices", "steps", "messages", "calls", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], "duration_s", ended.alias("ended_by"), "first_act", "last_act", "last_program"
    )


def turn_stats(turns: DataFrame) -> DataFrame:
    """Sums per trajectory and how its turns ended."""
    ends = [F.count_if(F.col("ended_by") == e).alias(f"ended_{e}") for e in ("interrupt", "ask", "response", "tool")]
    return turns.groupBy("key").agg(F.count("*").alias("turns"), F.sum("calls").alias("calls"), F.sum("failed_calls").alias("failed_calls"), *ends)


def oversight(turns: DataFrame, batch: str) -> DataFrame:
    """Per batch, shares of turns that ask or are interrupted, durations, calls per turn."""
    own = turns.groupBy(batch).agg(
        F.count("*").alias("turns"),
        F.avg((F.col("ended_by") == "ask").cast("double")).alias("ask_share"),
        F.avg((F.col("ended_by") == "interrupt").cast("double")).alias("interrupt_share"),
        F.avg("calls").alias("calls_per_turn"),
    )
    return own.join(quantiles(turns, [batch], "duration_s", {"duration_p50": 0.5, "duration_p99": 0.99}), batch, "left")
