"""Filters, fills, vocabularies and joins that turn raw logs into training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.derive import present


def filter_ads(log: DataFrame, videos: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """Drop log rows of AD videos and keep NORMAL videos; a third type stays in the log only."""
    if not enabled:
        return log, videos
    ads = videos.where(F.col("video_type") == "AD").select("video_id").distinct()
    return log.join(ads, "video_id", "left_anti"), videos.where(F.col("video_type") == "NORMAL")


def filter_active_users(log: DataFrame, least: int = 10) -> DataFrame:
    """Rows of users with at least ``least`` of them; a null user has no rows to count."""
    active = log.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("user_id")
    return log.join(active, "user_id", "left_semi")


def unite_policies(standard: DataFrame, random: DataFrame, least: int = 10) -> DataFrame:
    """Standard rows of active users and all random rows, each stamped with its policy."""
    stamp = lambda df, v: df.drop("is_rand").withColumn("is_rand", F.lit(v).cast("byte"))
    return filter_active_users(stamp(standard, 0), least).unionByName(stamp(random, 1), allowMissingColumns=True)


def in_domain(log: DataFrame, users: DataFrame, videos: DataFrame) -> DataFrame:
    """Add user_idx and video_idx; rows of unknown users or videos go."""
    return log.join(users.select(F.col("raw_id").alias("user_id"), F.col("idx").alias("user_idx")), "user_id").join(videos.select(F.col("raw_id").alias("video_id"), F.col("idx").alias("video_idx")), "video_id")


def left_features(log: DataFrame, features: DataFrame, key: str, suffix: str = "_item") -> DataFrame:
    """Left join of side features; their columns that clash with the log's get the suffix."""
    taken = set(log.columns)
    renamed = features.select(*[F.col(c) if c == key or c not in taken else F.col(c).alias(f"{c}{suffix}") for c in features.columns])
    return log.join(renamed, key, "left")


def medians(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, median) of numeric columns: the middle of the counted values in order, found by a running count."""
    from tributary.operators.prefix import ordered_prefix

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("x")).select("x.*").where("value is not null")
    counted = long.groupBy("name", "value").agg(F.count("*").alias("n"))
    upto = ordered_prefix(counted, [F.col("name"), F.col("value")], sums={"n": "upto"})
    ends = upto.groupBy("name").agg(F.min(F.col("upto") - F.col("n")).alias("before"), F.max("upto").alias("last"))  # a row a column
    placed = upto.join(F.broadcast(ends), "name").withColumn("lo", F.col("upto") - F.col("n") - F.col("before")).withColumn("hi", F.col("upto") - F.col("before")).withColumn("all", F.col("last") - F.col("before"))
    holds = lambda place: (F.col("lo") <= place) & (place < F.col("hi"))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = placed.where(holds(low) | holds(high)).groupBy("name").agg(F.avg("value").alias("median"))
    return middle


def fill_median(df: DataFrame, names: list[str]) -> DataFrame:
    """Numbers of texts; null or bad ones become the column's median, absent columns 0.

    A column without any number stays null.
    """
    have = present(df, names)
    out = df.withColumns({c: F.col(c).try_cast("double") for c in have})
    if have:
        found = {r["name"]: r["median"] for r in medians(out, have).collect()}  # a row a column
        out = out.withColumns({c: F.coalesce(c, F.lit(found.get(c)).cast("double")) for c in have})
    return out.withColumns({c: F.lit(0.0) for c in names if c not in have})


def minmax(df: DataFrame, column: str, name: str, fit_on: DataFrame | None = None, eps: float = 1e-9) -> DataFrame:
    """(x - min) / (max - min + eps) with the extremes of ``fit_on`` (``df`` itself by default); null is 0."""
    ends = (df if fit_on is None else fit_on).agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    scaled = (F.col(column).cast("double") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(eps))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.coalesce(scaled, F.lit(0.0))).drop("__lo", "__hi")  # one row


def vocabulary(tokens: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(token, n, idx): tokens seen at least ``least`` times, numbered from 1 in their order; 0 is left for the rest."""
    from tributary.operators.prefix import ordered_prefix

    kept = tokens.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return ordered_prefix(kept, [F.col("token")], rank="idx").withColumn("idx", F.col("idx") + 1)


def encode_tokens(df: DataFrame, column: str, vocab: DataFrame, name: str, unknown: int = 0) -> DataFrame:
    """Index of a token; what the vocabulary lacks is ``unknown``."""
    keyed = vocab.select(F.col("token").alias("__token"), F.col("idx").alias("__idx"))
    return df.join(keyed, F.col(column).cast("string") == F.col("__token"), "left").withColumn(name, F.coalesce("__idx", F.lit(unknown)).cast("long")).drop("__token", "__idx")


def encode_sequences(df: DataFrame, key: str, column: str, vocab: DataFrame, name: str, length: int = 50) -> DataFrame:
    """Sequence of indexes, at most the last ``length``, filled with 0 in front."""
    items = df.select(key, F.posexplode(F.slice(F.col(column), F.greatest(F.lit(1), F.size(column) - length + 1), length)).alias("__pos", "__item"))
    coded = encode_tokens(items, "__item", vocab, "__code")
    seq = coded.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__code"))), lambda x: x["__code"]).alias(name))
    filled = F.coalesce(F.col(name), F.array().cast("array<long>"))
    return df.join(seq, key, "left").withColumn(name, F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(filled)), filled))


def vocabulary_sizes(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """max + 1 of each integer feature, in one pass."""
    return df.agg(*[(F.coalesce(F.max(c), F.lit(-1)) + 1).alias(c) for c in present(df, names)])


def vector(names: tuple[str, ...] | list[str], df: DataFrame) -> Column:
    """Feature vector of the present columns, null as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present(df, names)])
