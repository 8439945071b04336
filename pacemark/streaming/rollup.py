"""Windowed I/O rates of a message stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.operators.telemetry import OK, UPDATE, parse_messages, windowed


def rate_windows(
    messages: DataFrame, width: str = "10 minutes", slide: str | None = None, delay: str = "1 minute"
) -> DataFrame:
    """Rates per cluster and event-time window; rows later than ``delay`` are dropped by Spark.

    Windows are aggregated per task before the shuffle, so a busy cluster costs one row per window.
    """
    updates = parse_messages(messages).where((F.col("verb") == UPDATE) & (F.col("status") == OK))
    rates = updates.select("cluster", "ts", F.trim("payload").cast("bigint").alias("rate"))
    return windowed(rates.withWatermark("ts", delay), "rate", "ts", width, slide)
