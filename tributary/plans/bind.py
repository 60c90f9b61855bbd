"""The given tables in the roles of logs, users, videos, vectors and predictions.

Each function has its SQL twin in ``BASE``, whose names the queries' SQL builds on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.derive import aspect_ratio, clipped_ratio, flag, log_count, ordinal, parse_tags, seconds

SEGMENTS = {"AUTOMOBILE": 3, "BUILDING": 2, "MACHINERY": 1}
GAP_MS = 6 * 3_600_000
#: Components of the embeddings.
WIDTH = 64


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_log(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions from ``events``: one row an event, the item is the number in its props."""
    e = read(spark, sf, "events")
    kind = lambda name: flag(F.col("event_type") == name)
    return e.select(
        F.col("event_id").alias("row_key"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("video_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("time_ms"),
        kind("click").alias("is_click"), kind("purchase").alias("is_like"), kind("signup").alias("is_follow"), kind("error").alias("is_hate"), kind("view").alias("long_view"),
        F.col("value").alias("play_time_ms"), ((F.col("event_id") % 7) * 20).cast("double").alias("duration_ms"), (F.col("event_id") % 15).cast("int").alias("tab"), flag(F.col("event_id") % 10 == 0).alias("is_rand"),
    )


def log(spark: SparkSession, sf: str) -> DataFrame:
    return raw_log(spark, sf).withColumn("play_ratio", clipped_ratio("play_time_ms", "duration_ms"))


def raw_videos(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    kind = F.when(F.col("p_type") == "PROMO", "AD").when(F.col("p_type") == "SMALL", "UNKNOWN").otherwise("NORMAL")
    number = lambda c: c.cast("long").cast("string")
    tag = F.concat_ws(",", number(F.col("p_size") % 8), F.concat(F.lit(" "), number(F.col("p_partkey") % 8), F.lit(" ")), F.lit("x"), number(F.col("p_partkey") * 7 % 8))
    return p.select(F.col("p_partkey").alias("video_id"), kind.alias("video_type"), F.when(F.col("p_partkey") % 9 != 0, tag).alias("tag"), (F.col("p_size") * 1000).alias("video_duration"), F.col("p_size").alias("server_width"), (F.col("p_size") % 7).alias("server_height"), F.col("p_retailprice").alias("price"))


def authors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("video_id")).agg(F.min("l_suppkey").alias("author_id"))


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by video from ``lineitem``: shows, valid plays, returns as likes."""
    li = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("video_id"))
    return li.agg(F.count("*").alias("show_cnt"), F.sum((F.col("l_quantity") > 25).cast("long")).alias("valid_play_cnt"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("like_cnt"))


def videos(spark: SparkSession, sf: str) -> DataFrame:
    v = raw_videos(spark, sf).join(statistics(spark, sf), "video_id", "left").join(authors(spark, sf), "video_id", "left")
    return v.select("video_id", "video_type", "author_id", parse_tags("tag").alias("tag_list"), aspect_ratio("server_width", "server_height").alias("aspect_ratio"), seconds("video_duration").alias("duration_s"), clipped_ratio("valid_play_cnt", "show_cnt").alias("global_cvr"), log_count("show_cnt").alias("log_show_cnt"), log_count("like_cnt").alias("log_like_cnt"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), ordinal("c_mktsegment", SEGMENTS).alias("activity"), log_count(F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("log_fans_user_num"), (F.col("c_nationkey") % 5).alias("onehot_feat0"), (F.col("c_custkey") % 3).alias("onehot_feat1"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(idx, emb): the embeddings."""
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("emb"))


def weights(k: int) -> np.ndarray:
    """The k-th matrix of a fixed rule, which ``mat`` follows in SQL."""
    i, j = np.ogrid[1 : WIDTH + 1, 1 : WIDTH + 1]
    return ((i * 37 + j * 101 + k * 13) % 41 - 20) / 159


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(user_idx, label, score, logit, ips) of every line item; many scores are equal."""
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_idx"))
    score = F.round((F.col("l_discount") * 10 + F.col("l_tax") * 5) / 2, 4)
    joined = li.join(o, "l_orderkey")
    return joined.select("user_idx", (F.col("l_returnflag") == "R").cast("int").alias("label"), score.alias("score"), ((F.col("l_quantity") - 25) / 5).alias("logit"), F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(F.col("l_quantity") / 3).alias("ips"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Run histories derived from ``lineitem``: a run a return flag and mode, an epoch a year of shipping."""
    li = read(spark, sf, "lineitem")
    run = F.concat(F.lit("1k_dual_kg"), (F.col("l_linenumber") % 3 * 32).cast("string"), F.lit("_ips"), (F.col("l_returnflag") == "R").cast("int").cast("string"), F.lit("_rg"), (F.col("l_linestatus") == "F").cast("int").cast("string"))
    by = li.groupBy(run.alias("run"), (F.year("l_shipdate") - 1990).alias("epoch"))
    mean = lambda c, d=1.0: F.round(F.avg(c) / d, 6)
    m = by.agg(mean("l_discount", 0.1).alias("auc"), mean("l_tax", 0.08).alias("ap"), mean("l_quantity", 50.0).alias("logloss"), mean("l_extendedprice", 1e5).alias("ndcg10"))
    test = F.struct("auc", F.when(~((F.col("epoch") == 3) & F.col("run").contains("kg64")), F.col("ap")).alias("ap"), "logloss", "ndcg10")
    return m.select("run", "epoch", F.when(F.col("epoch") % 11 != 10, test).alias("test"))


BASE = {
    "log": """SELECT *, CASE WHEN duration_ms = 0 THEN 0.0 ELSE least(greatest(play_time_ms / duration_ms, 0.0), 1.0) END AS play_ratio FROM (
      SELECT event_id AS row_key, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS video_id, epoch_us(ts) // 1000 AS time_ms,
        CAST(event_type = 'click' AS TINYINT) AS is_click, CAST(event_type = 'purchase' AS TINYINT) AS is_like, CAST(event_type = 'signup' AS TINYINT) AS is_follow, CAST(event_type = 'error' AS TINYINT) AS is_hate, CAST(event_type = 'view' AS TINYINT) AS long_view,
        value AS play_time_ms, CAST(event_id % 7 * 20 AS DOUBLE) AS duration_ms, CAST(event_id % 15 AS INTEGER) AS tab, CAST(event_id % 10 = 0 AS TINYINT) AS is_rand FROM events)""",
    "raw_videos": """SELECT p_partkey AS video_id, CASE p_type WHEN 'PROMO' THEN 'AD' WHEN 'SMALL' THEN 'UNKNOWN' ELSE 'NORMAL' END AS video_type,
        [p_size % 8, p_partkey % 8, p_partkey * 7 % 8] AS tags, p_size * 1000 AS video_duration, p_size AS server_width, p_size % 7 AS server_height, p_retailprice AS price FROM part""",
    "authors": "SELECT l_partkey AS video_id, min(l_suppkey) AS author_id FROM lineitem GROUP BY 1",
    "stats": "SELECT l_partkey AS video_id, count(*) AS show_cnt, CAST(sum(CAST(l_quantity > 25 AS INTEGER)) AS BIGINT) AS valid_play_cnt, CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS like_cnt FROM lineitem GROUP BY 1",
    "tags": "SELECT video_id, CAST(unnest(tags) AS INTEGER) AS tag FROM raw_videos WHERE video_id % 9 <> 0",
    "sess": """SELECT *, CAST(sum(fresh) OVER (ORDER BY user_id, time_ms, row_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM (
      SELECT *, CASE WHEN before IS NULL OR time_ms - before > 21600000 THEN 1 ELSE 0 END AS fresh FROM (
        SELECT *, lag(time_ms) OVER (PARTITION BY user_id ORDER BY time_ms, row_key) AS before FROM log))""",
    "nxt": """SELECT * FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY time_ms, row_key) AS seq, video_id AS src, lead(video_id) OVER (PARTITION BY session_id ORDER BY time_ms, row_key) AS dst, tab FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_ms DESC, row_key DESC) AS back FROM sess) WHERE back <= 50) WHERE dst IS NOT NULL""",
    "uid": "SELECT c_custkey AS raw_id, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM (SELECT DISTINCT c_custkey FROM customer)",
    "vid": "SELECT p_partkey AS raw_id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM (SELECT DISTINCT p_partkey FROM part)",
    "aid": "SELECT author_id AS raw_id, row_number() OVER (ORDER BY author_id) - 1 AS idx FROM (SELECT DISTINCT author_id FROM authors JOIN vid ON raw_id = video_id)",
    "cid": "SELECT tag AS raw_id, row_number() OVER (ORDER BY tag) - 1 AS idx FROM (SELECT DISTINCT tag FROM tags)",
    "known": "SELECT s.*, u.idx AS user_idx, v.idx AS video_idx FROM sess s JOIN uid u ON u.raw_id = s.user_id JOIN vid v ON v.raw_id = s.video_id",
    "feedback": """SELECT rel, user_idx AS src, video_idx AS dst FROM (
        SELECT 'clicked' AS rel, * FROM known WHERE is_click = 1 UNION ALL SELECT 'liked', * FROM known WHERE is_like = 1 UNION ALL
        SELECT 'followed', * FROM known WHERE is_follow = 1 UNION ALL SELECT 'hated', * FROM known WHERE is_hate = 1)""",
    "made": "SELECT v.idx AS src, a.idx AS dst FROM authors x JOIN vid v ON v.raw_id = x.video_id JOIN aid a ON a.raw_id = x.author_id",
    "tagged": "SELECT v.idx AS src, c.idx AS dst FROM tags t JOIN vid v ON v.raw_id = t.video_id JOIN cid c ON c.raw_id = t.tag",
    "followed_authors": "SELECT k.user_idx AS src, m.dst FROM known k JOIN made m ON m.src = k.video_idx WHERE is_follow = 1",
    "knxt": """SELECT * FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY time_ms, row_key) AS seq, video_idx AS src, lead(video_idx) OVER (PARTITION BY session_id ORDER BY time_ms, row_key) AS dst, tab FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_ms DESC, row_key DESC) AS back FROM known) WHERE back <= 50) WHERE dst IS NOT NULL""",
    "comp": f"SELECT vec_id AS idx, unnest(range(1, {WIDTH + 1})) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "mat": f"SELECT k, i, j, ((i * 37 + j * 101 + k * 13) % 41 - 20) / 159 AS w FROM (SELECT unnest(range(0, 6)) AS k), (SELECT unnest(range(1, {WIDTH + 1})) AS i), (SELECT unnest(range(1, {WIDTH + 1})) AS j)",
    "pred": """SELECT o_custkey AS user_idx, CAST(l_returnflag = 'R' AS INTEGER) AS label, round((l_discount * 10 + l_tax * 5) / 2, 4) AS score, (l_quantity - 25) / 5 AS logit,
        CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE l_quantity / 3 END AS ips FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "hist": """SELECT run, epoch, epoch % 11 <> 10 AS tested, auc, CASE WHEN NOT (epoch = 3 AND run LIKE '%kg64%') THEN ap END AS ap, logloss, ndcg10 FROM (
        SELECT '1k_dual_kg' || CAST(l_linenumber % 3 * 32 AS INTEGER) || '_ips' || CAST(l_returnflag = 'R' AS INTEGER) || '_rg' || CAST(l_linestatus = 'F' AS INTEGER) AS run, CAST(year(l_shipdate) - 1990 AS INTEGER) AS epoch,
          round(avg(l_discount) / 0.1, 6) AS auc, round(avg(l_tax) / 0.08, 6) AS ap, round(avg(l_quantity) / 50.0, 6) AS logloss, round(avg(l_extendedprice) / 1e5, 6) AS ndcg10 FROM lineitem GROUP BY 1, 2)""",
}
_NEEDS = {"tags": ["raw_videos"], "sess": ["log"], "nxt": ["sess"], "aid": ["authors", "vid"], "cid": ["tags"], "known": ["sess", "uid", "vid"], "feedback": ["known"], "made": ["authors", "vid", "aid"], "tagged": ["tags", "vid", "cid"], "followed_authors": ["known", "made"], "knxt": ["known"]}


def sql(body: str, *names: str) -> str:
    """``body`` with the named base views, and those that they need, before it as CTEs."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        done[name] = BASE[name]

    for name in names:
        need(name)
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in done.items()) + "\n" + body if done else body
