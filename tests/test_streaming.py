"""Numbered sessions of streams replayed in several batches and orders."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tributary.operators.sessions import sessionize
from tributary.streaming import PROVIDER, numbered_sessions

GAP_MS = 1_800_000


def replay(spark, batches, folder, late="2 hours"):
    """Batches of (row_key, user_id, ts), each a file, through the stream one after another."""
    schema = "row_key long, user_id long, ts timestamp, note string"
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame([(*r, f"n{r[0]}") for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            query = numbered_sessions(stream, GAP_MS, late).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
            query.awaitTermination(180)
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
    return spark.read.parquet(f"{folder}/out")


def batch_numbers(spark, rows):
    log = spark.createDataFrame(rows, "row_key long, user_id long, ts timestamp").withColumn("time_ms", F.unix_millis("ts"))
    by_user = {}
    for r in sessionize(log, GAP_MS).collect():
        by_user.setdefault(r.user_id, []).append((r.session_id, r.row_key))
    return {key: session - min(x[0] for x in held) + 1 for held in by_user.values() for session, key in held}


def test_replayed_batches_equal_the_batch_rule(spark, tmp_path):
    """Rows come in disorder within two hours, over three batches (restarts) with ties and gaps of exactly 30 minutes."""
    draw, start = random.Random(3), datetime(2024, 1, 1)
    at, rows = {u: 0 for u in (1, 2, 3)}, []
    for k in range(90):
        user = draw.choice([1, 1, 1, 2, 3])
        at[user] += draw.choice([0, 60, 600, 1800, 1801, 4000])
        rows.append((k, user, start + timedelta(seconds=at[user], milliseconds=draw.choice([0, 0, 1]))))
    rows.append((91, None, start))
    rows.sort(key=lambda r: r[2])
    last = (1000, 9, rows[-1][2] + timedelta(days=2))  # moves the watermark past all
    batches = [rows[:30], rows[30:60], rows[60:]]
    for b in batches:
        draw.shuffle(b)
    # a few rows arrive a batch late, within the two hours
    edge = [r for r in batches[0] if r[2] > max(x[2] for x in batches[0]) - timedelta(hours=1)][:4]
    batches[0] = [r for r in batches[0] if r not in edge]
    batches[1] += [r for r in edge if r[2] > max(x[2] for x in batches[0]) - timedelta(hours=2)]
    whole = [r for b in batches for r in b]
    got = replay(spark, [*batches, [last]], tmp_path)
    assert got.columns == ["row_key", "user_id", "ts", "note", "session"]
    found = {r.row_key: r.session for r in got.collect()}
    assert found == batch_numbers(spark, whole)
    assert all(r.note == f"n{r.row_key}" for r in got.collect())


def test_rows_wait_for_the_watermark(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, 1, start), (2, 1, start + timedelta(minutes=10)), (3, 1, start + timedelta(hours=3)), (4, 1, None)]
    got = replay(spark, [rows], tmp_path)
    assert sorted((r.row_key, r.session) for r in got.collect()) == [(1, 1), (2, 1)]  # row 3 may still get a predecessor
