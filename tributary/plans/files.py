"""Queries of readers and writers: given tables are written as files of the log format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import graph as G
from tributary.operators import metrics as M
from tributary.operators import runs as K
from tributary.operators import sessions as S
from tributary.operators.prefix import shared_dir
from tributary.plans import bind as B
from tributary.plans.bind import sql
from tributary.sources import logs, runs
from tributary.sources.files import move

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, text: str | None):
    def keep(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return keep


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def log_columns(s: SparkSession, sf: str) -> DataFrame:
    """Interactions under the names of the log format; some feedback is missing."""
    e = B.raw_log(s, sf)
    return e.select("row_key", "user_id", "video_id", F.lit("20220421").alias("date"), "time_ms", "is_click", F.when(F.col("row_key") % 5 != 0, F.col("is_like")).alias("is_like"), "is_follow", "is_hate", "long_view", "play_time_ms", "duration_ms", "tab", "is_rand")


def as_files(s: SparkSession, sf: str, size: str = "1k") -> str:
    """A folder of the log format and one of its sizes: two standard periods, random rows, users, videos, statistics.

    The second standard period holds its first half again, as whole periods may repeat.
    """
    root, log = folder(s, "files"), log_columns(s, sf)
    put = lambda df, name: df.write.option("header", True).csv(f"{root}/{name}")
    standard = log.where("is_rand = 0")
    put(standard.where("row_key % 2 = 0").drop("row_key"), f"log_standard_1_{size}.csv")
    odd = standard.where("row_key % 2 = 1")
    put(odd.unionByName(odd.where("row_key % 4 = 1")).drop("row_key"), f"log_standard_2_{size}.csv")
    put(log.where("is_rand = 1").withColumn("is_rand", F.lit(0)).drop("row_key"), f"log_random_1_{size}.csv")  # the file decides, not the column
    c = B.read(s, sf, "customer")
    put(c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 != 3, F.element_at(F.array(F.lit("full_active"), F.lit("high_active"), F.lit("middle_active")), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("user_active_degree"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("long").alias("fans_user_num")), f"user_features_{size}.csv")
    v = B.raw_videos(s, sf).join(B.authors(s, sf), "video_id", "left")
    put(v.select("video_id", "author_id", "video_type", F.when(F.col("video_id") % 7 != 0, F.col("video_duration")).alias("video_duration"), "server_width", "server_height", "tag"), f"video_features_basic_{size}.csv")
    put(B.statistics(s, sf).withColumn("play_progress", F.lit(0.5)), f"video_features_statistic_{size}.csv")
    return root


LOGGED = """SELECT user_id, video_id, time_ms, is_click, CASE WHEN row_key % 5 <> 0 THEN is_like ELSE 0 END AS is_like, is_rand, tab, CASE WHEN duration_ms = 0 THEN 0.0 ELSE least(greatest(CAST(CAST(play_time_ms AS FLOAT) AS DOUBLE) / duration_ms, 0.0), 1.0) END AS play_ratio, copies
    FROM (SELECT *, unnest(range(CASE WHEN is_rand = 0 AND row_key % 4 = 1 THEN 2 ELSE 1 END)) AS copies FROM log) WHERE video_id NOT IN (SELECT video_id FROM raw_videos WHERE video_type = 'AD')"""
UNITED = f"SELECT * FROM ({LOGGED}) WHERE is_rand = 1 OR user_id IN (SELECT user_id FROM ({LOGGED}) WHERE is_rand = 0 GROUP BY 1 HAVING count(*) >= 10)"


@query("files_log", sql(f"SELECT user_id, video_id, time_ms, is_rand, tab, CAST(sum(is_click) AS BIGINT) AS clicks, CAST(sum(is_like) AS BIGINT) AS likes, round(max(play_ratio), 6) AS play_ratio, count(*) AS n FROM ({UNITED}) GROUP BY 1, 2, 3, 4, 5", "log", "raw_videos"))
def files_log(s, sf):
    """Layout, validation, typed reading, ad filter, active users, both policies; repeated rows stay."""
    by = logs.load_dataset(s, as_files(s, sf)).log.groupBy(*[F.col(c).cast("long").alias(c) for c in ("user_id", "video_id", "time_ms", "is_rand", "tab")])
    return by.agg(F.sum("is_click").alias("clicks"), F.sum("is_like").alias("likes"), F.round(F.max("play_ratio"), 6).alias("play_ratio"), F.count("*").alias("n"))


@query("files_row_keys", sql(f"SELECT count(*) AS n, count(*) AS keys FROM ({UNITED})", "log", "raw_videos"))
def files_row_keys(s, sf):
    """As many row keys as rows, though rows repeat."""
    return logs.load_dataset(s, as_files(s, sf)).log.agg(F.count("*").alias("n"), F.count_distinct("row_key").alias("keys"))


@query("files_sessions", sql(f"""SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY time_ms, copies, video_id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN time_ms - lag(time_ms) OVER (PARTITION BY user_id ORDER BY time_ms, copies, video_id) <= 21600000 THEN 0 ELSE 1 END AS fresh FROM ({UNITED}))) GROUP BY 1, 2) GROUP BY 1""", "log", "raw_videos"))
def files_sessions(s, sf):
    d = logs.load_dataset(s, as_files(s, sf), gap_ms=B.GAP_MS)
    return d.sessions.groupBy("user_id", "session_id").agg(F.count("*").alias("n")).groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("files_users", sql("SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS activity, round(ln(1 + trunc(greatest(c_acctbal, 0))), 6) AS log_fans FROM customer"))
def files_users(s, sf):
    d = logs.load_dataset(s, as_files(s, sf))
    return d.users.select(F.col("user_id").cast("long").alias("user_id"), F.col("activity").cast("int").alias("activity"), F.round("log_fans_user_num", 6).alias("log_fans"))


@query("files_users_larger", sql("SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS activity FROM customer"))
def files_users_larger(s, sf):
    """A folder with files of both sizes: the larger set is the one that is read."""
    root = as_files(s, sf, "27k")
    s.range(3).select((-F.col("id") - 1).alias("user_id"), F.lit("full_active").alias("user_active_degree")).write.option("header", True).csv(f"{root}/user_features_1k.csv")
    d = logs.load_dataset(s, root)
    return d.users.select(F.col("user_id").cast("long").alias("user_id"), F.col("activity").cast("int").alias("activity"))


@query("files_videos", sql("""SELECT v.video_id, a.author_id, CASE WHEN video_id % 9 <> 0 THEN len(tags) ELSE 0 END AS tags, round(coalesce(CASE WHEN show_cnt = 0 THEN 0 ELSE least(valid_play_cnt / show_cnt, 1) END, 0), 6) AS cvr, round(coalesce(ln(1 + show_cnt), 0), 6) AS log_show,
    round(CASE WHEN video_id % 7 <> 0 THEN video_duration / 1000.0 ELSE 0 END, 6) AS duration FROM raw_videos v LEFT JOIN stats USING (video_id) LEFT JOIN authors a USING (video_id) WHERE video_type = 'NORMAL'""", "raw_videos", "stats", "authors"))
def files_videos(s, sf):
    v = logs.load_dataset(s, as_files(s, sf)).videos
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6)
    return v.select(F.col("video_id").cast("long").alias("video_id"), F.col("author_id").cast("long").alias("author_id"), F.size("tag_list").cast("long").alias("tags"), zero("global_cvr").alias("cvr"), zero("log_show_cnt").alias("log_show"), zero("duration_s").alias("duration"))


@query("files_text_log", sql("SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, CAST(sum(is_click) AS DOUBLE) AS clicks FROM log WHERE is_rand = 0 AND row_key % 2 = 0 GROUP BY 1", "log"))
def files_text_log(s, sf):
    return logs.read_log_as_strings(s, [f"{as_files(s, sf)}/log_standard_1_1k.csv"]).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("is_click").alias("clicks"))


def run_folders(s: SparkSession, sf: str) -> str:
    """A folder a run: a history as one JSON array, and a log with two test evaluations; some runs have the log only."""
    root, h = folder(s, "runs"), B.history(s, sf)
    rows = h.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "test"))).alias("rows"))
    last = K.last_epoch(h).select("run", *[F.coalesce(F.format_string("%.6f", m), F.lit("-")).alias(m) for m in K.METRICS])
    line = lambda m: F.concat(F.lit("[Metrics] logloss: "), m("logloss"), F.lit(" - AUC: "), m("auc"), F.lit(" - AP: "), m("ap"), F.lit(" - NDCG(10): "), m("ndcg10"))
    text = F.concat_ws("\n", line(lambda m: F.lit("0.1")), F.lit("*** Test evaluation ***"), line(lambda m: F.lit("0.2")), F.lit("*** Test evaluation ***"), line(F.col))
    for name, made in (("history.json", rows.where("run not like '%kg32%'").select("run", F.to_json("rows").alias("value"))), ("train.log", last.select("run", text.alias("value")))):
        made.repartition(1, "run").write.option("lineSep", "\x1e").partitionBy("run").text(f"{root}-{name}")
        move(s, f"{root}-{name}/run=*/part-*", lambda path, name=name: f"{root}/{path.split('/run=')[1].split('/')[0]}/{name}")  # as many as runs
    return root


@query("files_histories", sql("SELECT run, epoch, auc, ap FROM (SELECT run, epoch, CASE WHEN tested THEN auc END AS auc, CASE WHEN tested THEN ap END AS ap FROM hist) WHERE run NOT LIKE '%kg32%'", "hist"))
def files_histories(s, sf):
    return runs.read_run_histories(s, run_folders(s, sf)).where("readable").select("run", "epoch", "test.auc", "test.ap")


@query("files_training_logs", sql("SELECT run, last(auc ORDER BY epoch) AS auc, last(ap ORDER BY epoch) AS ap, last(logloss ORDER BY epoch) AS logloss, last(ndcg10 ORDER BY epoch) AS ndcg10 FROM hist WHERE tested AND run LIKE '%kg32%' GROUP BY 1", "hist"))
def files_training_logs(s, sf):
    root = run_folders(s, sf)
    return runs.read_training_logs(s, root, runs.read_run_histories(s, root).where("readable"))


@query("files_predictions", sql("SELECT CAST(label AS INTEGER) AS label, round(score, 4) AS score, count(*) AS n FROM pred GROUP BY 1, 2", "pred"))
def files_predictions(s, sf):
    at = folder(s, "predictions")
    B.predictions(s, sf).select(F.monotonically_increasing_id().alias("id"), F.lit("x").alias("note"), "label", "score").write.parquet(at)
    rows = s.read.parquet(at)
    found = runs.read_predictions(rows.select("id", "note", "score"), rows.select("id", "label"), "id", "label")
    return found.groupBy("label", F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))


@query("files_prediction_fallbacks", sql("SELECT * FROM (SELECT 'log' AS source, 0.75::DOUBLE AS auc, 0.5::DOUBLE AS logloss, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_pos FROM pred UNION ALL SELECT 'counts', NULL, NULL, count(*), CAST(sum(label) AS BIGINT) FROM pred)", "pred"))
def files_prediction_fallbacks(s, sf):
    """Predictions of another size: the log's metrics stand in, and without a log the counts of labels alone."""
    labels = B.predictions(s, sf).select(F.monotonically_increasing_id().alias("id"), "label")
    short, log = labels.select("id", F.lit(0.5).alias("p")).where("id < 1"), s.createDataFrame([(0.75, 0.5)], "auc double, logloss double")
    rows = [runs.split_metrics(short, labels, "id", "label", x).select(F.lit(name).alias("source"), "auc", "logloss", "n_samples", "n_pos") for name, x in (("log", log), ("counts", None))]
    return rows[0].unionByName(rows[1])


POSITION = "SELECT *, CASE WHEN place <= (SELECT floor(count(*) * 0.8) FROM log) THEN 'train' WHEN place <= (SELECT floor(count(*) * 0.9) FROM log) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY CAST(user_id AS VARCHAR), time_ms, row_key) AS place FROM log)"


def damaged_files(s: SparkSession, sf: str) -> str:
    """``as_files`` with two more standard periods and other users, in which values and lines are broken by rule."""
    root, log = as_files(s, sf), log_columns(s, sf).where("is_rand = 0")
    names = [c for c in log.columns if c != "row_key"]
    key, text = F.col("row_key"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    broken = {"time_ms": F.when(key % 11 == 3, "soon"), "play_time_ms": F.when(key % 13 == 5, "1 500"), "tab": F.when(key % 17 == 2, "999")}
    fields = [F.coalesce(broken[c], text(c)) if c in broken else text(c) for c in names]
    line = F.when(key % 19 == 4, F.concat_ws(",", *fields[:4])).when(key % 19 == 5, F.concat_ws(",", *fields, F.lit("more"))).otherwise(F.concat_ws(",", *fields))
    head = s.range(1).select(F.lit(",".join(names)).alias("value"))
    for part in range(2):
        lines = log.where(key % 2 == part).select(line.alias("value"))
        # a file a task has its own header
        lines.coalesce(1).union(head).repartition(1).sortWithinPartitions(F.col("value").startswith("user_id").desc()).write.text(f"{root}/log_standard_{part + 3}_1k.csv")
    c = B.read(s, sf, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.when(F.col("c_custkey") % 5 == 1, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("fans_user_num"))
    c.write.mode("overwrite").option("header", True).csv(f"{root}/user_features_1k.csv")
    return root


REJECTS = """SELECT 'standard' AS role, CASE row_key % 2 WHEN 0 THEN 'log_standard_3_1k.csv' ELSE 'log_standard_4_1k.csv' END AS file, "column", reason, count(*) AS n FROM (
    SELECT row_key, unnest([CASE WHEN row_key % 11 = 3 THEN 'time_ms' END, CASE WHEN row_key % 13 = 5 AND row_key % 19 <> 4 THEN 'play_time_ms' END, CASE WHEN row_key % 17 = 2 AND row_key % 19 <> 4 THEN 'tab' END]) AS "column", 'value' AS reason FROM log WHERE is_rand = 0)
    WHERE "column" IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'standard', CASE row_key % 2 WHEN 0 THEN 'log_standard_3_1k.csv' ELSE 'log_standard_4_1k.csv' END, NULL, 'line', count(*) FROM log WHERE is_rand = 0 AND row_key % 19 IN (4, 5) GROUP BY ALL
  UNION ALL SELECT 'users', 'user_features_1k.csv', 'fans_user_num', 'value', count(*) FROM customer WHERE c_custkey % 5 = 1 HAVING count(*) > 0"""


@query("files_rejects", sql(REJECTS, "log"))
def files_rejects(s, sf):
    """Bad values and lines of the wrong length by file and column."""
    return logs.check_inputs(s, damaged_files(s, sf))


@query("files_bad_histories", sql("SELECT run, CASE WHEN run LIKE '%_ips1_%' THEN 'no json ' || run END AS text, run NOT LIKE '%_ips1_%' AS readable, count(*) AS n FROM (SELECT run, epoch FROM hist WHERE run NOT LIKE '%_ips1_%' UNION ALL SELECT DISTINCT run, 0 FROM hist WHERE run LIKE '%_ips1_%') GROUP BY ALL", "hist"))
def files_bad_histories(s, sf):
    """Histories of which some are no JSON: those keep their text."""
    root, h = folder(s, "histories"), B.history(s, sf)
    good = h.where("run not like '%\\_ips1\\_%'").groupBy("run").agg(F.to_json(F.array_sort(F.collect_list(F.struct("epoch", "test")))).alias("value"))
    bad = h.where("run like '%\\_ips1\\_%'").select("run").distinct().withColumn("value", F.concat(F.lit("no json "), "run"))
    good.unionByName(bad).repartition(1, "run").write.option("lineSep", "\x1e").partitionBy("run").text(f"{root}-made")
    move(s, f"{root}-made/run=*/part-*", lambda path: f"{root}/{path.split('/run=')[1].split('/')[0]}/history.json")  # as many as runs
    found = runs.read_run_histories(s, root)
    return found.groupBy("run", F.rtrim(F.col("text"), F.lit("\x1e")).alias("text"), "readable").agg(F.count("*").alias("n"))


@query("files_splits", sql(f"SELECT split, row_key FROM ({POSITION})", "log"))
def files_splits(s, sf):
    at = folder(s, "splits")
    runs.write_splits(S.positional_split(B.log(s, sf)).select("row_key", "split"), at, "csv")
    return s.read.option("header", True).schema("row_key long, split string").csv(at)


@query("files_split_stats", sql(f"SELECT coalesce(split, 'ALL') AS split, count(*) AS total, CAST(sum(is_click) AS BIGINT) AS pos FROM ({POSITION}) GROUP BY ROLLUP (split)", "log"))
def files_split_stats(s, sf):
    at = folder(s, "stats")
    runs.write_rows(S.split_statistics(S.positional_split(B.log(s, sf))), at)
    return s.read.json(at).select("split", "total", "pos")


@query("files_metrics", sql("SELECT 'test' AS split, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_pos FROM pred", "pred"))
def files_metrics(s, sf):
    at = folder(s, "metrics")
    runs.write_rows(M.counts(B.predictions(s, sf)).withColumn("split", F.lit("test")), at, "csv")
    return s.read.option("header", True).schema("n_samples long, n_pos long, pos_rate double, split string").csv(at).select("split", "n_samples", "n_pos")


@query("files_graph", sql("SELECT rel, src, dst, count(*) AS n FROM (SELECT * FROM feedback UNION ALL SELECT 'made_by', src, dst FROM made) GROUP BY 1, 2, 3", "feedback", "made"))
def files_graph(s, sf):
    """A graph saved by its first use and loaded by the second."""
    from tributary.plans.graph import graph

    at = folder(s, "graph")
    for _ in range(2):
        g = G.load_or_build(s, at, lambda: graph(s, sf))
    return g.edges.where(F.col("rel").isin("clicked", "liked", "followed", "hated", "made_by")).groupBy("rel", "src", "dst").agg(F.count("*").alias("n"))
