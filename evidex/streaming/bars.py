"""Bars from a stream of ticks, an extension: hourly windows with a watermark for late ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of ticks (symbol, ts, event_id, value); a bar is final once its window is `late` past."""
    at = F.struct("ts", "event_id")
    b = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    b = b.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return b.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
