"""Streaming forms of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.streaming.numbered import PROVIDER, numbered_sessions

__all__ = ["PROVIDER", "numbered_sessions", "session_windows"]


def session_windows(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """(user_id, started, ended, n): sessions of a stream of rows, closed once the watermark has passed them.

    A session goes on while the gap is at most ``gap``, as in batch; rows later than ``late`` are dropped.
    """
    windows = log.withWatermark(time, late).groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return windows.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
