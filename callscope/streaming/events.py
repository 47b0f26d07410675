"""Structured Streaming: windowed counts, debounced triggers, and rows put in the place of others; ``maintain`` keeps a whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """Events with ``ts`` as a point in time, and on a stream with a watermark."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return source.withWatermark("ts", late) if events.isStreaming else source


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``start, event_type, n, value`` for tumbling windows; a batch or a stream."""
    source = timed(events, late)
    agg = source.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def debounced(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``user_id, start, n``: bursts of a user's events with no pause over ``gap``; each triggers once."""
    source = timed(events, late)
    agg = source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), "n")


def upserted(current: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``changed`` instead of those of the same key."""
    return current.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that a stream gives for what has arrived, as a table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)
