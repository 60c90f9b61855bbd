"""Running values over ranges equal windows by key, whatever the batches and partitions; a hot key is many tasks."""

from __future__ import annotations

from random import Random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tributary.operators import propagate as P
from tributary.operators import sessions as S
from tributary.operators.scan import Running, running

CONF = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}


@pytest.fixture
def small(spark):
    """Many partitions of few rows, in batches of three."""
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def log(spark, n, seed, users=(None, 1, 1, 1, 1, 2, 3), step=40):
    rng = Random(seed)
    rows = [(k, rng.choice(users), rng.choice([None, *range(5)]), rng.choice([None, *[step * rng.randrange(60) for _ in range(9)]]), rng.choice([None, 0, 1]), rng.choice("ab")) for k in range(n)]
    return spark.createDataFrame(rows, "row_key long, user_id long, video_id long, time_ms long, is_click int, kind string")


def by_windows(df, keys, gap, most):
    w = Window.partitionBy(*keys).orderBy("time_ms", "row_key")
    first = F.row_number().over(w) == 1
    before = F.lag("time_ms").over(w)
    fresh = F.when(first | before.isNull() | (F.col("time_ms") - before > gap), 1).otherwise(0)
    out = df.withColumn("fresh", fresh).withColumn("seen", F.sum(F.coalesce("is_click", F.lit(0)).cast("long")).over(w)).withColumn("hist", F.collect_list("video_id").over(w.rowsBetween(-most, -1)))
    return out.withColumn("run", F.sum("fresh").over(Window.orderBy(*keys, "time_ms", "row_key"))).drop("fresh")


@pytest.mark.parametrize("keys", [("user_id",), ("user_id", "kind")])
@pytest.mark.parametrize("n, most", [(0, 4), (1, 4), (13, 4), (200, 4), (200, 50)])
def test_running_equals_windows(small, keys, n, most):
    df = log(small, n, n + most)
    got = running(df, Running(keys, ("time_ms", "row_key"), {"is_click": "seen"}, {"video_id": ("hist", most)}, ("time_ms", 500, "run")))
    want = by_windows(df, keys, 500, most)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("n, most, rows", [(0, 4, 5), (1, 4, 5), (13, 4, 5), (200, 4, 5), (200, 50, 5), (200, 50, 1), (200, 7, 1000)])
def test_blocks_tell_all_lists(small, n, most, rows):
    """A block's first list and its rows give every row's list, nulls included."""
    df = log(small, n, n + most)
    got = running(df, Running(("user_id",), ("time_ms", "row_key"), back={"video_id": ("hist", most)}, blocks=("block", rows))).collect()
    want = {r.row_key: [x.video_id for x in r.hist] for r in by_windows(df.withColumn("video_id", F.struct("video_id")), ("user_id",), 500, most).collect()}
    places, before, seen = [], None, {}
    for r in sorted(got, key=lambda r: (r.block, r.block_at)):
        assert r.block_at == (0 if before is None or before.block != r.block else before.block_at + 1) < rows and (not r.hist or r.block_at == 0)
        places = list(r.hist) if r.block_at == 0 else places
        seen[r.row_key] = places[len(places) - r.hist_size :]
        places.append(r.video_id)
        before = r
    assert seen == want


def test_repeated_rows(small):
    """Equal rows follow each other: each has its own place."""
    df = small.createDataFrame([(1, 1, 7, 10, 1, "a")] * 40, "row_key long, user_id long, video_id long, time_ms long, is_click int, kind string")
    got = running(df, Running(("user_id",), ("time_ms", "row_key"), {"is_click": "seen"}, {"video_id": ("hist", 5)})).collect()
    assert sorted(r.seen for r in got) == list(range(1, 41)) and sorted(len(r.hist) for r in got) == [0, 1, 2, 3, 4] + [5] * 35


def test_columns_of_all_kinds_pass(small):
    df = log(small, 30, 1).withColumns({"at": F.timestamp_millis("time_ms"), "map": F.create_map("kind", "user_id"), "gone": F.lit(None).cast("string"), "list": F.array("kind"), "price": F.lit(1).cast("decimal(9,2)"), "day": F.current_date()})
    got = S.sessionize(df, 500).drop("session_id")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect())) and got.dtypes == df.dtypes


def test_hot_user_is_many_tasks(small):
    """Half of all rows are one user's: they lie in many partitions, and results equal the windows."""
    df = log(small, 3000, 9, users=(1, 1, 1, 2, 3, 4), step=7)
    sessions = S.sessionize(df, 60)
    want = by_windows(df, ("user_id",), 60, 50).select("row_key", "run")
    assert sorted(map(tuple, sessions.select("row_key", "session_id").collect())) == sorted(map(tuple, want.collect()))
    plan = sessions._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" not in plan  # no shuffle by user, which would make it one task
    (path,) = {f.rsplit("/", 1)[0] for f in sessions.inputFiles()}
    tasks = small.read.parquet(path).groupBy("__part").agg(F.count("*").alias("rows"), F.count(F.when(F.col("user_id") == 1, 1)).alias("hot")).collect()
    assert len(tasks) == 13 and sum(r.hot > 0 for r in tasks) >= 6 and max(r.rows for r in tasks) < 3000 / 13 * 1.6
    hist = {r.row_key: r.hist for r in S.histories(df).collect()}
    assert hist == {r.row_key: r.hist for r in by_windows(df, ("user_id",), 60, 50).collect() if r.hist}


def test_path_counts_of_a_hot_user_and_author(small):
    df = log(small, 600, 4, users=(1, 1, 2))
    authors = small.createDataFrame([(k, 1) for k in range(4)] + [(4, None)], "video_id long, author_id long")
    tags = small.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 1), (2, 1)], "video_id long, tag int")
    rows = sorted(df.collect(), key=lambda r: (r.time_ms is not None, r.time_ms or 0, r.row_key))
    of = {0: {1, 2}, 1: {1}, 2: {1}}
    want, seen = {}, {}
    for r in rows:
        earlier = [v for v in seen.setdefault(r.user_id, []) if r.video_id is not None]
        want[r.row_key] = (sum(v < 4 for v in earlier) if r.video_id is not None and r.video_id < 4 else 0, sum(len(of.get(v, set()) & of.get(r.video_id, set())) for v in earlier))
        if r.is_click and r.video_id is not None:
            seen[r.user_id].append(r.video_id)
    assert {r.row_key: (r.same_author, r.same_category) for r in P.path_counts(df, authors, tags).collect()} == want
