"""Interaction logs and side tables: layout, validation, typed readers, the composed dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.derive import aspect_ratio, clipped_ratio, flag, log_count, ordinal, parse_tags, seconds
from tributary.operators.clean import filter_ads, unite_policies
from tributary.operators.graph import category_map, id_map
from tributary.operators.prefix import ordered_prefix
from tributary.operators.sessions import GAP_MS, sessionize
from tributary.schema import FLAGS, LOG, USER_COUNTS, VIDEO_COUNTS, VIDEO_STATISTICS
from tributary.sources.files import exists, glob
from tributary.sources.quarantine import bad_rows, checked_csv, rejects, unique

# File names of the two published sizes of the data set.
SIZES = ("27k", "1k")
NAMES = {
    "standard": "log_standard_*_{size}*.csv",
    "random": "log_random_*_{size}*.csv",
    "users": "user_features_{size}.csv",
    "video_basic": "video_features_basic_{size}.csv",
    "video_statistic": "video_features_statistic_{size}*.csv",
}


def detect_layout(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Files by role: of the larger set if its user file is there, else of the smaller."""
    size = next((s for s in SIZES if exists(spark, f"{folder}/{NAMES['users'].format(size=s)}")), SIZES[-1])
    return {role: glob(spark, f"{folder}/{name.format(size=size)}") for role, name in NAMES.items()}


def validate_inputs(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The layout; raises FileNotFoundError that names every missing role."""
    layout = detect_layout(spark, folder)
    if missing := [NAMES[r] for r, paths in layout.items() if not paths]:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    return layout


def _csv(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.option("header", True).csv(paths)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def log_types(columns: list[str]) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in LOG.fields if f.name in columns}


def user_types(columns: list[str]) -> dict[str, str]:
    """All columns but names and ranges are numbers."""
    text = lambda c: c == "user_active_degree" or c.endswith("_range")
    return {c: "int" if c == "user_id" or c.startswith("is_") else "double" for c in columns if not text(c)}


def basic_types(columns: list[str]) -> dict[str, str]:
    kinds = {"video_id": "int", "author_id": "int", "video_duration": "double", "server_width": "double", "server_height": "double"}
    return {c: t for c, t in kinds.items() if c in columns}


def statistic_types(columns: list[str]) -> dict[str, str]:
    return {c: "int" if c == "video_id" else "double" for c in VIDEO_STATISTICS if c in columns}


#: By role, the types that its reader gives to the columns that its files have.
TYPES = {"standard": log_types, "random": log_types, "users": user_types, "video_basic": basic_types, "video_statistic": statistic_types}


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns with a type as that type, bad values null; others as they are."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def check_inputs(spark: SparkSession, folder: str, bad_records: str | None = None) -> DataFrame:
    """(role, file, column, reason, n): what the readers cannot take from a folder's files, counted.

    ``reason`` is "value" for values that are not of their column's type (read as null) and "line" for lines
    with too few or too many fields (column null).  With ``bad_records`` the lines themselves are written there by role.
    """
    out = None
    for role, paths in validate_inputs(spark, folder).items():
        columns = [c.strip() for c in spark.read.option("header", True).csv(paths).columns]
        checked = checked_csv(spark, paths, TYPES[role](columns))
        if bad_records:
            bad_rows(checked).write.mode("overwrite").json(f"{bad_records}/role={role}")
        found = rejects(checked).select(F.lit(role).alias("role"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def read_interactions(spark: SparkSession, paths: list[str], random: bool) -> DataFrame:
    """One policy's log: declared columns that the files have, typed; flags without null; the policy from the file."""
    df = _csv(spark, paths, LOG.fieldNames())
    df = _typed(df, log_types(df.columns))
    df = df.withColumns({c: flag(c) for c in FLAGS if c in df.columns})
    return df.withColumn("is_rand", F.lit(int(random)).cast("byte")).withColumn("play_ratio", clipped_ratio("play_time_ms", "duration_ms"))


def read_user_features(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Names and ranges as text, all other columns as numbers."""
    df = _csv(spark, paths)
    df = _typed(df, user_types(df.columns))
    if "user_active_degree" in df.columns:
        df = df.withColumn("activity", ordinal("user_active_degree"))
    return df.withColumns({f"log_{c}": log_count(c) for c in USER_COUNTS if c in df.columns})


def read_video_basic(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = _csv(spark, paths)
    df = _typed(df, basic_types(df.columns))
    derived = {"tag_list": (("tag",), parse_tags), "aspect_ratio": (("server_width", "server_height"), aspect_ratio), "duration_s": (("video_duration",), seconds)}
    return df.withColumns({name: f(*need) for name, (need, f) in derived.items() if set(need) <= set(df.columns)})


def read_video_statistic(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = _csv(spark, paths, list(VIDEO_STATISTICS))
    df = _typed(df, statistic_types(df.columns))
    if {"valid_play_cnt", "show_cnt"} <= set(df.columns):
        df = df.withColumn("global_cvr", clipped_ratio("valid_play_cnt", "show_cnt"))
    return df.withColumns({f"log_{c}": log_count(c) for c in VIDEO_COUNTS if c in df.columns})


@dataclass(frozen=True)
class Dataset:
    """Lazy tables of a data set."""

    log: DataFrame
    sessions: DataFrame
    users: DataFrame
    videos: DataFrame
    user_ids: DataFrame
    video_ids: DataFrame
    author_ids: DataFrame
    categories: DataFrame


def load_dataset(spark: SparkSession, folder: str, min_interactions: int = 10, drop_ads: bool = True, gap_ms: int = GAP_MS, bad_records: str | None = None) -> Dataset:
    """Read, filter, unite, sessionize and number a folder of files.

    Rows have no key of their own: ``row_key`` is the place in the order of time, user and a hash of the row.
    Equal rows get different keys, and which gets which makes no difference.  A user or video with several rows
    in its side table fails with its id: joined as it is, it would double rows, nodes and edges.  With
    ``bad_records`` what the readers reject is written there (``check_inputs``).
    """
    layout = validate_inputs(spark, folder)
    standard, random = (read_interactions(spark, layout[p], p == "random") for p in ("standard", "random"))
    if bad_records:
        check_inputs(spark, folder, bad_records)
    basic = unique(read_video_basic(spark, layout["video_basic"]), "video_id", "video features")
    if drop_ads:
        standard, videos = filter_ads(standard, basic)
        random, _ = filter_ads(random, basic)
    else:
        videos = basic
    log = unite_policies(standard, random, min_interactions)
    log = ordered_prefix(log, [F.col("time_ms"), F.col("user_id"), F.xxhash64(*log.columns)], rank="row_key")
    videos = videos.join(unique(read_video_statistic(spark, layout["video_statistic"]), "video_id", "video statistics"), "video_id", "left")
    users = unique(read_user_features(spark, layout["users"]), "user_id", "user features")
    return Dataset(log, sessionize(log, gap_ms), users, videos, id_map(users, "user_id"), id_map(videos, "video_id"), id_map(videos, "author_id"), category_map(videos))


def read_log_as_strings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns as text, names trimmed; feedback flags as floats where they are numbers."""
    df = _csv(spark, paths)
    return df.withColumns({c: F.col(c).try_cast("float") for c in FLAGS if c in df.columns})
