"""Keyed, step-ordered views over the driver tables.

``chat_steps`` reads conversations; ``trace_steps`` and ``trace_actions`` read an event log as agent traces: a view
is what the user asks, a sign-up interrupts, and clicks, purchases and errors are actions, errors being failed ones.
What an action does and on which object comes from the number in its properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ACTS = ("read", "edit", "test", "run", "ask")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, step, role, kind, name, content, timestamp."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("key"),
        F.col("turn").alias("step"),
        "role",
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("name"),
        F.col("text").alias("content"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"),
        (F.row_number().over(own) - 1).cast("long").alias("step"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("ts").alias("timestamp"),
    )


def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, step, role, kind, name, content, timestamp, is_error, k, value."""
    said = F.col("event_type")
    return _trace(spark, sf_dir).select(
        "key",
        "step",
        F.when(said.isin("view", "signup"), "user").otherwise("assistant").alias("role"),
        F.when(said == "view", "message").when(said == "signup", "notice").otherwise("tool_call").alias("kind"),
        F.when(said == "signup", "interruption").when(said == "view", F.lit(None)).otherwise(F.concat(F.lit("tool"), (F.col("k") % 3).cast("string"))).alias("name"),
        F.concat(said, F.lit(" "), F.col("k").cast("string")).alias("content"),
        "timestamp",
        (said == "error").alias("is_error"),
        "k",
        "value",
    )


def trace_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, position, call, ordinal, turn, tool, act, program, effect, outcome, paths, text."""
    before = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = _trace(spark, sf_dir).withColumn("turn", F.sum((F.col("event_type") == "view").cast("long")).over(before))
    acts = F.element_at(F.array(*map(F.lit, ACTS)), (F.col("k") % 5 + 1).cast("int"))
    own = Window.partitionBy("key").orderBy("step")
    return steps.filter(F.col("event_type").isin("click", "purchase", "error")).select(
        "key",
        (F.row_number().over(own) - 1).cast("long").alias("position"),
        F.col("step").alias("call"),
        F.lit(0).alias("ordinal"),
        "turn",
        F.concat(F.lit("tool"), (F.col("k") % 3).cast("string")).alias("tool"),
        acts.alias("act"),
        F.concat(F.lit("p"), (F.col("k") % 4).cast("string")).alias("program"),
        F.when((F.col("k") % 5 == 3) & (F.col("k") % 2 == 0), "destructive").when(F.col("k") % 5 == 1, "workspace").otherwise("none").alias("effect"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"),
        F.array(F.concat(F.lit("f"), (F.col("k") % 7).cast("string"))).alias("paths"),
        F.concat(F.lit("t"), (F.col("k") % 20).cast("string")).alias("text"),
    )
