"""Sessions, behaviour histories and splits of a log ordered by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.prefix import ordered_prefix
from tributary.operators.scan import Running, running

GAP_MS = 1_800_000


def sessionize(log: DataFrame, gap_ms: int = GAP_MS, time: str = "time_ms", key: str = "row_key") -> DataFrame:
    """Add session_id, 1-based in (user, time) order; a session ends with a gap strictly longer than ``gap_ms``.

    Ties in time follow the key.  One scan in order counts the starts of sessions: a user with many rows is
    spread over partitions.
    """
    return running(log, Running(("user_id",), (time, key), gaps=(time, gap_ms, "session_id")))


def session_tail(sessions: DataFrame, most: int = 50, time: str = "time_ms", key: str = "row_key") -> DataFrame:
    """The last ``most`` rows of every session."""
    last_first = Window.partitionBy("session_id").orderBy(F.col(time).desc(), F.col(key).desc())
    return sessions.withColumn("__back", F.row_number().over(last_first)).where(F.col("__back") <= most).drop("__back")


def next_in_session(sessions: DataFrame, item: str = "video_id", most: int = 50, time: str = "time_ms", key: str = "row_key") -> DataFrame:
    """(session_id, seq, src, dst, tab): each row of a session's tail and the one after it."""
    w = Window.partitionBy("session_id").orderBy(time, key)
    tail = session_tail(sessions, most, time, key)
    pairs = tail.select("session_id", F.row_number().over(w).cast("long").alias("seq"), F.col(item).alias("src"), F.lead(item).over(w).alias("dst"), F.lead(key).over(w).alias("__after"), F.col("tab"))
    return pairs.where(F.col("__after").isNotNull()).drop("__after")


def last_items(pairs: DataFrame) -> DataFrame:
    """(session_id, last): target of each session's last pair."""
    return pairs.groupBy("session_id").agg(F.max_by("dst", "seq").alias("last"))


def histories(log: DataFrame, most: int = 50, item: str = "video_id", time: str = "time_ms", key: str = "row_key") -> DataFrame:
    """Add hist: the user's up to ``most`` items before the row; rows without any are dropped.

    The items of a user that lie before a partition's first rows are handed on, at most ``most`` a partition.
    """
    return running(log, Running(("user_id",), (time, key), back={item: ("hist", most)})).where(F.size("hist") > 0)


def temporal_split(log: DataFrame, test_ratio: float = 0.2, time: str = "time_ms", key: str = "row_key") -> DataFrame:
    """Add split: the first int(n * (1 - ratio)) rows by time are train, the rest test."""
    cut = int(log.count() * (1 - test_ratio))
    ranked = ordered_prefix(log, [F.col(time), F.col(key)], rank="__rank")
    return ranked.withColumn("split", F.when(F.col("__rank") < cut, "train").otherwise("test")).drop("__rank")


def positional_split(log: DataFrame, train: float = 0.8, valid: float = 0.1, time: str = "time_ms", key: str = "row_key") -> DataFrame:
    """Add split by position in (user as text, time) order: train, valid, test blocks."""
    n = log.count()
    ends = int(n * train), int(n * (train + valid))
    ranked = ordered_prefix(log.withColumn("__user", F.col("user_id").cast("string")), [F.col("__user"), F.col(time), F.col(key)], rank="__rank")
    which = F.when(F.col("__rank") < ends[0], "train").when(F.col("__rank") < ends[1], "valid").otherwise("test")
    return ranked.withColumn("split", which).drop("__rank", "__user")


def split_statistics(rows: DataFrame, label: str = "is_click") -> DataFrame:
    """(split, total, pos, neg, ctr) by split and for ALL."""
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    counted = rows.withColumn("__y", y).rollup("split").agg(F.count("*").alias("total"), F.sum("__y").alias("pos"))
    ctr: Column = F.col("pos") / F.greatest(F.col("total"), F.lit(1))
    return counted.select(F.coalesce("split", F.lit("ALL")).alias("split"), "total", "pos", (F.col("total") - F.col("pos")).alias("neg"), ctr.alias("ctr"))


def summary(log: DataFrame) -> DataFrame:
    """One row: users, videos, rows by policy, sessions."""
    rand = F.col("is_rand") == 1
    return log.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("video_id").alias("videos"), F.sum((~rand).cast("long")).alias("standard_rows"), F.sum(rand.cast("long")).alias("random_rows"), F.countDistinct("session_id").alias("sessions"))
