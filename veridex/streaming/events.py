"""Optional extras, beyond parity: streams of events and traces with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.operators.trace import EVENT


def trace_stream(spark: SparkSession, path: str) -> DataFrame:
    """A trace folder as a stream: files that are appended are read once each."""
    return spark.readStream.schema(EVENT).json(path)


def windowed(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts", by: list[str] = ("event_type",)) -> DataFrame:
    """window_start, the grouping columns, n and total of value: tumbling windows, or sliding ones; works on streams and tables."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", user: str = "user_id") -> DataFrame:
    """user, session_start and n: a session ends after a gap without events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("session_start"), "n")
