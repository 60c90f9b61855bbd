"""Queries of cleaning, derivations, vocabularies and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.functions import derive as D
from tributary.operators import clean as C
from tributary.plans import bind as B
from tributary.plans.bind import sql

r6 = lambda c: F.round(c, 6)

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, text: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, text
        return f

    return keep


@query("play_ratio", sql("SELECT row_key, round(play_ratio, 6) AS play_ratio FROM log", "log"))
def play_ratio(s, sf):
    return B.log(s, sf).select("row_key", r6("play_ratio").alias("play_ratio"))


@query("ips_weights", sql("SELECT is_rand, count(*) AS n, CASE WHEN is_rand = 1 THEN 1.0 ELSE 0.9963 END::DOUBLE AS ips FROM log GROUP BY is_rand", "log"))
def ips_weights(s, sf):
    return B.log(s, sf).select("is_rand", D.ips_weight("is_rand").alias("ips")).groupBy("is_rand", "ips").agg(F.count("*").alias("n"))


@query("activity_ordinal", "SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS activity, round(ln(1 + greatest(c_acctbal, 0)), 6) AS log_fans FROM customer")
def activity_ordinal(s, sf):
    return B.users(s, sf).select("user_id", "activity", r6("log_fans_user_num").alias("log_fans"))


@query("tag_parse", sql("SELECT video_id, tag, count(*) AS n FROM tags GROUP BY 1, 2", "tags"))
def tag_parse(s, sf):
    return B.raw_videos(s, sf).select("video_id", F.explode(D.parse_tags("tag")).alias("tag")).groupBy("video_id", "tag").agg(F.count("*").alias("n"))


@query("video_shape", sql("SELECT video_id, round(coalesce(server_width / nullif(server_height, 0), 1.0), 6) AS aspect_ratio, round(video_duration / 1000, 6) AS duration_s FROM raw_videos", "raw_videos"))
def video_shape(s, sf):
    return B.videos(s, sf).select("video_id", r6("aspect_ratio").alias("aspect_ratio"), r6("duration_s").alias("duration_s"))


@query("video_statistics", sql("SELECT video_id, round(coalesce(valid_play_cnt / nullif(show_cnt, 0), 0.0), 6) AS global_cvr, round(ln(1 + coalesce(show_cnt, 0)), 6) AS log_show, round(ln(1 + coalesce(like_cnt, 0)), 6) AS log_like FROM raw_videos LEFT JOIN stats USING (video_id)", "raw_videos", "stats"))
def video_statistics(s, sf):
    return B.videos(s, sf).select("video_id", r6("global_cvr").alias("global_cvr"), r6("log_show_cnt").alias("log_show"), r6("log_like_cnt").alias("log_like"))


@query("edge_attributes", sql("SELECT row_key, [round(play_ratio, 6), long_view::DOUBLE, round(tab / 14, 6), CASE WHEN is_rand = 1 THEN 1.0 ELSE 0.9963 END]::DOUBLE[] AS attr FROM log", "log"))
def edge_attributes(s, sf):
    attr = D.edge_attributes("play_ratio", "long_view", "tab", D.ips_weight("is_rand"))
    return B.log(s, sf).select("row_key", F.transform(attr, lambda x: F.round(x, 6)).alias("attr"))


@query("unknown_fill", "SELECT p_brand, coalesce(nullif(p_type, 'PROMO'), 'unknown') AS p_type, count(*) AS n FROM part GROUP BY 1, 2")
def unknown_fill(s, sf):
    p = B.read(s, sf, "part").select("p_brand", F.nullif("p_type", F.lit("PROMO")).alias("p_type"))
    return D.fill_unknown(p, ("p_brand", "p_type", "absent")).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("median_fill", "WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part) SELECT p_partkey, round(coalesce(price, (SELECT median(price) FROM t)), 6) AS price, 0.0::DOUBLE AS absent FROM t")
def median_fill(s, sf):
    p = B.read(s, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice").cast("string")).otherwise(F.lit("bad")).alias("price"))
    return C.fill_median(p, ["price", "absent"]).withColumn("price", r6("price"))


@query("minmax_time", sql("SELECT row_key, round((time_ms - lo) / (hi - lo + 1e-9), 6) AS timestamp_norm FROM log, (SELECT min(time_ms) AS lo, max(time_ms) AS hi FROM log)", "log"))
def minmax_time(s, sf):
    return C.minmax(B.log(s, sf), "time_ms", "timestamp_norm").select("row_key", r6("timestamp_norm").alias("timestamp_norm"))


@query("minmax_train", sql("SELECT row_key, round((duration_ms - lo) / (hi - lo + 1e-9), 6) AS scaled FROM log, (SELECT min(duration_ms) AS lo, max(duration_ms) AS hi FROM log WHERE is_rand = 0)", "log"))
def minmax_train(s, sf):
    log = B.log(s, sf)
    return C.minmax(log, "duration_ms", "scaled", log.where("is_rand = 0")).select("row_key", r6("scaled").alias("scaled"))


@query("label_coerce", "SELECT o_orderpriority, CAST(sum(coalesce(try_cast(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '1.0' ELSE 'x' END AS DOUBLE), 0)) AS BIGINT) AS positives FROM orders GROUP BY 1")
def label_coerce(s, sf):
    k = F.col("o_orderkey") % 3
    return B.read(s, sf, "orders").select("o_orderpriority", D.label(F.when(k == 1, "1.0").when(k == 2, "x")).alias("y")).groupBy("o_orderpriority").agg(F.sum("y").alias("positives"))


@query("vocab_sizes", "SELECT max(c_nationkey % 5) + 1 AS onehot_feat0, max(c_custkey % 3) + 1 AS onehot_feat1 FROM customer")
def vocab_sizes(s, sf):
    return C.vocabulary_sizes(B.users(s, sf), ["onehot_feat0", "onehot_feat1", "onehot_feat2"])


VOCAB = "SELECT token, n, row_number() OVER (ORDER BY token) AS idx FROM (SELECT CAST(video_id AS VARCHAR) AS token, count(*) AS n FROM log WHERE is_click = 1 GROUP BY 1 HAVING count(*) >= 2)"


@query("vocab_min_count", sql(VOCAB, "log"))
def vocab_min_count(s, sf):
    return C.vocabulary(B.log(s, sf).where("is_click = 1"), "video_id", 2)


@query("token_encode", sql(f"SELECT coalesce(v.idx, 0) AS code, count(*) AS n FROM log LEFT JOIN ({VOCAB}) v ON v.token = CAST(video_id AS VARCHAR) GROUP BY 1", "log"))
def token_encode(s, sf):
    log = B.log(s, sf)
    return C.encode_tokens(log, "video_id", C.vocabulary(log.where("is_click = 1"), "video_id", 2), "code").groupBy("code").agg(F.count("*").alias("n"))


@query("feature_vectors", sql("SELECT c_custkey AS user_id, [CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END, round(ln(1 + greatest(c_acctbal, 0)), 6), c_nationkey % 5, c_custkey % 3]::DOUBLE[] AS features FROM customer"))
def feature_vectors(s, sf):
    u = B.users(s, sf)
    return u.select("user_id", F.transform(C.vector(("activity", "absent", "log_fans_user_num", "onehot_feat0", "onehot_feat1"), u), lambda x: F.round(x, 6)).alias("features"))


@query("user_counts", sql("SELECT user_id, count(*) AS n FROM log GROUP BY 1", "log"))
def user_counts(s, sf):
    return B.log(s, sf).groupBy("user_id").agg(F.count("*").alias("n"))


@query("active_users", sql("SELECT row_key, user_id FROM log WHERE user_id IN (SELECT user_id FROM log GROUP BY 1 HAVING count(*) >= 68)", "log"))
def active_users(s, sf):
    return C.filter_active_users(B.log(s, sf), 68).select("row_key", "user_id")


@query("ad_filter", sql("SELECT video_id, count(*) AS n, CAST(bool_or(video_type = 'NORMAL') AS INTEGER) AS listed FROM log JOIN raw_videos USING (video_id) WHERE video_type <> 'AD' GROUP BY 1", "log", "raw_videos"))
def ad_filter(s, sf):
    log, videos = C.filter_ads(B.log(s, sf), B.raw_videos(s, sf))
    counted = log.groupBy("video_id").agg(F.count("*").alias("n"))
    return counted.join(videos.select("video_id", F.lit(1).alias("one")), "video_id", "left").select("video_id", "n", F.coalesce("one", F.lit(0)).alias("listed"))


@query("policy_union", sql("SELECT is_rand, count(*) AS n, count(DISTINCT user_id) AS users FROM log WHERE is_rand = 1 OR user_id IN (SELECT user_id FROM log WHERE is_rand = 0 GROUP BY 1 HAVING count(*) >= 61) GROUP BY 1", "log"))
def policy_union(s, sf):
    log = B.log(s, sf)
    return C.unite_policies(log.where("is_rand = 0"), log.where("is_rand = 1"), 61).groupBy("is_rand").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("id_domain", sql("SELECT row_key, user_idx, video_idx FROM known", "known"))
def id_domain(s, sf):
    from tributary.operators.graph import id_map

    return C.in_domain(B.log(s, sf), id_map(B.users(s, sf), "user_id"), id_map(B.raw_videos(s, sf), "video_id")).select("row_key", "user_idx", "video_idx")


@query("log_user_features", sql("SELECT row_key, c_mktsegment AS segment, c_nationkey AS nation FROM log LEFT JOIN customer ON c_custkey = user_id", "log"))
def log_user_features(s, sf):
    u = B.read(s, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return C.left_features(B.log(s, sf), u, "user_id").select("row_key", "segment", "nation")


@query("log_video_features", sql("SELECT row_key, tab, video_type, server_width AS tab_item FROM log LEFT JOIN raw_videos USING (video_id)", "log", "raw_videos"))
def log_video_features(s, sf):
    v = B.raw_videos(s, sf).select("video_id", "video_type", F.col("server_width").alias("tab"))
    return C.left_features(B.log(s, sf), v, "video_id").select("row_key", "tab", "video_type", "tab_item")


@query("sales_click_rates", """SELECT o_custkey AS user_id, count(*) AS n, CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS clicks, count(DISTINCT l_partkey) AS videos
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) >= 10""")
def sales_click_rates(s, sf):
    o = B.read(s, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    li = B.read(s, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return li.join(o, "l_orderkey").groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("clicks"), F.countDistinct("l_partkey").alias("videos")).where("n >= 10")
