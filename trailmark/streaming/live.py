"""The event log as a stream, beyond the reference's batch re-runs: windowed counts and failure runs per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; rows later than the watermark are left out by the stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    return grouped.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    return grouped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def live_failure_runs(events: DataFrame, run: int = 3) -> DataFrame:
    """user_id, event_id of the event that completes ``run`` errors in a row among a user's actions, as it arrives.

    State per user is one number; rows of a batch are taken in time order.
    """

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        length = state.get[0] if state.exists else 0
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        found = []
        for event, kind in zip(rows.event_id, rows.event_type, strict=True):
            length = length + 1 if kind == "error" else 0
            if length == run:
                found.append(event)
        state.update((length,))
        yield pd.DataFrame({"user_id": [key[0]] * len(found), "event_id": found})

    actions = events.filter(F.col("event_type").isin("click", "purchase", "error")).select("user_id", "event_id", "ts", "event_type")
    return actions.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_id long", "length long", "append", "NoTimeout")
