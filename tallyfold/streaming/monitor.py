"""Operational counts of a stream of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(
    stream: DataFrame, outcome: str, ts: str = "received_at", width: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Rows per closed window and outcome."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), outcome)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), outcome, "n")
    )


def session_counts(
    stream: DataFrame, user: str, ts: str = "received_at", gap: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Rows per closed session: arrivals of a user less than ``gap`` apart."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(user, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(user, F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), "n")
    )
