"""Readers and writers on files made by the test."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tributary.sources import logs, runs
from tributary.sources.quarantine import duplicates, unique
from tributary.streaming import session_windows

HEAD = "user_id,video_id,date,time_ms,is_click,is_like,play_time_ms,duration_ms,is_rand,tab"


@pytest.fixture
def folder(tmp_path):
    row = lambda u, v, t, rand: f"{u},{v},20220421,{t},1,,{500},{1000},{rand},3"
    (tmp_path / "log_standard_1_1k.csv").write_text("\n".join([HEAD, *[row(1, 10, 1000 + k, 1) for k in range(6)]]))
    (tmp_path / "log_standard_2_1k.csv").write_text("\n".join([HEAD, *[row(1, 11, 2000 + k, 1) for k in range(5)], row(2, 10, 5, 0), row(1, 12, 7, 0)]))
    (tmp_path / "log_random_1_1k.csv").write_text("\n".join([HEAD, row(2, 13, 9, 0), row(2, 12, 9, 0)]))
    (tmp_path / "user_features_1k.csv").write_text("user_id,user_active_degree,fans_user_num\n1,full_active,9\n2,other,\n")
    (tmp_path / "video_features_basic_1k.csv").write_text('video_id,author_id,video_type,video_duration,server_width,server_height,tag\n10,5,NORMAL,2000,720,1280,"1,2"\n11,6,NORMAL,,720,0,\n12,6,AD,1,1,1,3\n13,7,OTHER,1,1,1,4\n')
    (tmp_path / "video_features_statistic_1k.csv").write_text("video_id,show_cnt,valid_play_cnt,counts,play_progress\n10,4,1,9,9\n11,0,5,9,9\n")
    return tmp_path


def test_dataset(spark, folder):
    d = logs.load_dataset(spark, str(folder))
    rows = d.log.collect()
    assert {(r.user_id, r.is_rand) for r in rows} == {(1, 0), (2, 1)}  # few standard rows of user 2 go, the random one stays
    assert {r.video_id for r in rows} == {10, 11, 13} and all(r.is_like == 0 and r.play_ratio == 0.5 for r in rows)
    assert d.sessions.count() == len(rows)
    videos = {r.video_id: r for r in d.videos.collect()}
    assert set(videos) == {10, 11} and videos[10].tag_list == [1, 2] and videos[11].aspect_ratio == 1.0 and videos[10].global_cvr == 0.25 and videos[11].global_cvr == 0.0
    assert "play_progress" not in d.videos.columns
    assert [r.idx for r in d.user_ids.orderBy("raw_id").collect()] == [0, 1]
    assert {r.user_id: r.activity for r in d.users.collect()} == {1: 3, 2: 0}


def test_missing_files_are_all_named(spark, folder):
    (folder / "user_features_1k.csv").unlink()
    (folder / "log_random_1_1k.csv").unlink()
    with pytest.raises(FileNotFoundError, match="log_random.*user_features"):
        logs.validate_inputs(spark, str(folder))


def test_text_log_and_histories(spark, folder):
    df = logs.read_log_as_strings(spark, [str(folder / "log_standard_1_1k.csv")])
    kinds = dict(df.dtypes)
    assert kinds["user_id"] == "string" and kinds["is_click"] == "float"
    text = runs.history_as_text(spark.createDataFrame([([1, 2],), ([],)], "hist array<long>"))
    assert [r.hist for r in text.collect()] == ["1 2", "0"]


def test_run_files(spark, tmp_path):
    for run, body in (("a", json.dumps([{"epoch": 1, "test": {"auc": 0.5, "ap": None}}, {"epoch": 2, "train": {"auc": 0.7}, "lr": 0.1}])), ("b", "{broken")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "history.json").write_text(body)
    (tmp_path / "c").mkdir()
    log = "[Metrics] logloss: 0.9 - AUC: 0.1 - AP: 0.1 - NDCG(10): 0.1\n*** Test evaluation ***\n[Metrics] logloss: 0.6 - AUC: 0.69 - AP: 0.5 - NDCG(10): 0.7\n"
    for run in ("a", "c"):
        (tmp_path / run / "train.log").write_text(log)
    history = runs.read_run_histories(spark, str(tmp_path))
    good = {(r.run, r.epoch) for r in history.where("readable").collect()}
    assert good == {("a", 1), ("a", 2)} and {r.run for r in history.where("not readable").collect()} == {"b"}
    found = runs.read_training_logs(spark, str(tmp_path), history.where("readable")).collect()
    assert [tuple(r) for r in found] == [("c", 0.69, 0.5, 0.6, 0.7)]


def test_predictions_need_equal_counts(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "id long, y int")
    p = spark.createDataFrame([(2, "x", 0.5), (1, "y", 0.25)], "id long, name string, p float")
    assert sorted(tuple(r) for r in runs.read_predictions(p, labels, "id", "y").collect()) == [(1, 0, 0.25), (2, 1, 0.5)]
    assert runs.read_predictions(p.limit(1), labels, "id", "y") is None and runs.read_predictions(labels, labels, "id", "y") is None


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "x long, split string")
    runs.write_splits(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    runs.write_splits(rows, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("split = 'test'").first().x == "2"
    runs.write_rows(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_streamed_sessions_equal_the_batch_rule(spark, tmp_path):
    """Exactly 30 minutes apart stays together, a second more does not."""
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 01:00:01"), (2, "2024-01-05 00:00:00")]
    spark.createDataFrame(rows, "user_id long, ts string").select("user_id", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    query = session_windows(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.user_id, r.n) for r in spark.table("sessions_out").collect())
    assert got == [(1, 1), (1, 2)]  # user 2's is still open


def test_repeated_keys_fail_with_the_key(spark, folder):
    """A video in two statistics parts would double its node; the join names it instead."""
    (folder / "video_features_statistic_1k_2.csv").write_text("video_id,show_cnt,valid_play_cnt,counts,play_progress\n10,4,1,9,9\n")
    with pytest.raises(Exception, match="video statistics: video_id 10 has 2 rows"):
        logs.load_dataset(spark, str(folder)).videos.collect()
    (folder / "video_features_statistic_1k_2.csv").write_text("video_id,show_cnt,valid_play_cnt,counts,play_progress\n13,4,1,9,9\n")
    assert logs.load_dataset(spark, str(folder)).videos.count() == 2
    (folder / "user_features_1k.csv").write_text("user_id,user_active_degree\n1,full_active\n1,other\n")
    with pytest.raises(Exception, match="user features: user_id 1 has 2 rows"):
        logs.load_dataset(spark, str(folder)).users.collect()


def test_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (None, "b"), (None, "c")], "k int, v string")
    assert sorted(map(tuple, unique(df, "k", "t").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    twice = df.unionByName(df)
    assert sorted(map(tuple, duplicates(twice, "k").collect())) == [(1, 2), (2, 2)]
    with pytest.raises(Exception, match="t: k [12] has 2 rows"):
        unique(twice, "k", "t").collect()
    joined = unique(df, "k", "t").join(spark.createDataFrame([(1,)], "k int"), "k")
    assert [tuple(r) for r in joined.collect()] == [(1, "a")]


def test_rejected_values_and_lines(spark, folder):
    bad = folder / "log_standard_2_1k.csv"
    bad.write_text("\n".join([HEAD, "1,10,20220421,soon,1,,500,1000,0,3", "1,10,20220421,5", "1,10,20220421,5,1,,500,1000,0,3,9", "x,10,20220421,5,1,,5e2,1000,0,300"]))
    out = folder / "bad"
    logs.load_dataset(spark, str(folder), bad_records=str(out))
    found = {(r.role, r.file, r.column, r.reason): r.n for r in logs.check_inputs(spark, str(folder)).collect()}
    name = "log_standard_2_1k.csv"
    assert found == {("standard", name, "time_ms", "value"): 1, ("standard", name, "user_id", "value"): 1, ("standard", name, "tab", "value"): 1, ("standard", name, None, "line"): 2}
    rows = spark.read.json(f"{out}/role=standard").collect()
    assert len(rows) == 4 and {r.line for r in rows if "line" in r and r.line} == {"1,10,20220421,5", "1,10,20220421,5,1,,500,1000,0,3,9"}
    assert any("soon" in r.fields and r.columns == ["time_ms"] for r in rows)


def test_unreadable_histories_keep_their_text(spark, tmp_path):
    for run, text in (("a", '[{"epoch": 1}]'), ("b", "no json {"), ("c", "[]")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "history.json").write_text(text)
    found = {r.run: (r.readable, r.text) for r in runs.read_run_histories(spark, str(tmp_path)).collect()}
    assert found == {"a": (True, None), "b": (False, "no json {")}
