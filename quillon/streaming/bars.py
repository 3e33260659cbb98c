"""Bars of an event stream: tumbling windows with a watermark, the panel's observed cells as they close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(events: DataFrame, width: str = "6 hours", late: str = "1 hour", code: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """(code, ts, v, n) from a streaming or batch frame of events; events later than ``late`` are left out of a stream."""
    e = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(code).alias("code"), F.col(value).alias("v"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w"), "code").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return g.select("code", F.col("w.start").alias("ts"), "v", "n")
