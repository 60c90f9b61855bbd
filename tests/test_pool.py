"""Pooled histories equal sums over the lists, and what moves does not grow with lists times vectors."""

from __future__ import annotations

from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import propagate as P
from tributary.operators import sessions as S
from tributary.operators.blocks import rounded

WIDTH = 4


def log(spark, n, seed, users=(None, 1, 1, 1, 2, 3), items=9):
    rng = Random(seed)
    rows = [(k, rng.choice(users), rng.choice([None, *range(items)]), rng.choice([None, *range(60)])) for k in range(n)]
    return spark.createDataFrame(rows, "row_key long, user_id long, video_id long, time_ms long")


def vectors(spark, odd=None):
    """Item 8 has no vector, 7 none that is not null, 6 two, 5 a null component, 4 perhaps an odd one."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=WIDTH)]) for k in (*range(8), 6)]
    rows[7] = (7, None)
    rows[5] = (5, [None, *rows[5][1][1:]])
    if odd is not None:
        rows[4] = (4, [odd, *rows[4][1][1:]])
    return spark.createDataFrame(rows, "idx long, emb array<float>")


def of_idx(df):
    """idx -> its vectors added up, nulls as 0, as float32 stores them."""
    out = {}
    for r in df.collect():
        if r.emb is not None:
            out[r.idx] = out.get(r.idx, 0) + np.array([0.0 if x is None else x for x in r.emb])
    return out


def by_hand(lists, emb):
    """key -> pooled, of (key, target, list)."""
    out = {}
    for key, target, items in lists:
        known = [emb[i] for i in items if i in emb] if target in emb else []
        out[key] = sum([(v @ emb[target]) * v for v in known], np.zeros(WIDTH))
    return out


def lists_of(df, most):
    """(row_key, item, list with nulls) of each row that has rows of its user before it."""
    seen, out = {}, []
    for r in sorted(df.collect(), key=lambda r: (r.time_ms is not None, r.time_ms or 0, r.row_key)):
        before = seen.setdefault(r.user_id, [])
        if before:
            out.append((r.row_key, r.video_id, before[-most:]))
        before.append(r.video_id)
    return out


def same(got, want):
    got = {r[0]: np.array(r.pooled) for r in got.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-9, atol=1e-9)


@pytest.fixture
def small(spark, monkeypatch):
    """Many partitions and blocks of few rows, in batches of three."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(P, "BLOCK", 5)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n, most, odd", [(0, 4, None), (1, 4, None), (200, 4, None), (200, 50, None), (60, 4, float("inf"))])
def test_pool_of_a_log(small, n, most, odd):
    """Nulls keep their place; ties, repeated, null and missing vectors count as in a join of components."""
    df, v = log(small, n, n + most), vectors(small, odd)
    want = by_hand(lists_of(df, most), of_idx(v))
    assert odd is None or any(np.isfinite(x).all() and x.any() for x in want.values()) and not all(np.isfinite(x).all() for x in want.values())
    same(P.history_pool_of_log(df, v, WIDTH, most), want)


def test_pool_of_lists(small):
    """Any lists, among them null and empty ones; each row has a result."""
    rng = Random(5)
    lists = [(k, rng.choice([None, *range(9)]), rng.choice([None, [], *[[rng.choice([None, *range(9)]) for _ in range(rng.randrange(12))] for _ in range(4)]])) for k in range(90)]
    df, v = small.createDataFrame(lists, "id long, target long, hist array<long>"), vectors(small)
    same(P.history_pool(df, v, "id", "hist", "target", WIDTH), by_hand([(k, t, h or []) for k, t, h in lists], of_idx(v)))


def test_no_vector_at_all(small):
    df = log(small, 20, 1)
    same(P.history_pool_of_log(df, vectors(small).where("idx < 0"), WIDTH), by_hand(lists_of(df, 50), {}))


def test_spans():
    """Products of spans of places equal a sum of each list, however long lists are against a span."""
    rng = np.random.default_rng(8)
    table = np.r_[rng.normal(size=(30, WIDTH)), np.zeros((1, WIDTH))]
    n = 1500
    places, end = rng.integers(-1, 30, n), np.arange(n)
    start = np.maximum.accumulate(np.maximum(end - rng.choice([3, 50, 400], n), end // 700 * 700))
    got = P._windows(table, places, start, end, places)
    want = [((table[places[s:e]] @ table[places[e]])[:, None] * table[places[s:e]]).sum(0) for s, e in zip(start, end, strict=True)]
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_rounding(spark):
    """As F.round, in both directions, at halves, and of what is no number."""
    x = np.r_[np.random.default_rng(1).normal(scale=5, size=3000), 0.5, -0.5, 2.5, 0.00005, -0.00004, 0.0, -0.0, 0.375, 1e20, np.inf, -np.inf, np.nan]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for digits in (0, 2, 4):
        want = [r.y for r in df.select((F.round("x", digits) + F.lit(0.0)).alias("y")).collect()]
        got = rounded(x, digits)
        np.testing.assert_array_equal(got, want)
        assert not np.signbit(got[got == 0]).any()


def written_bytes(spark):
    """Shuffled bytes of all stages so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_few_bytes_move(spark):
    """20,000 rows of 64 components: a pooled vector a row and part of the items took 537 bytes a row."""
    rows = spark.range(20_000).select(F.col("id").alias("row_key"), (F.col("id") % 300).alias("user_id"), (F.xxhash64("id") % 50 + 50).alias("video_id"), (F.col("id") * 1000).alias("time_ms"))
    v = spark.range(100).select(F.col("id").alias("idx"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("id"))).alias("emb"))
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/rows-of-pool"
    rows.write.parquet(folder)
    rows = spark.read.parquet(folder)
    for pooled in (lambda: P.history_pool_of_log(rows, v, 64), lambda: P.history_pool(S.histories(rows), v, "row_key", "hist", "video_id", 64)):
        before = written_bytes(spark)
        pooled().write.format("noop").mode("overwrite").save()
        assert 0 < written_bytes(spark) - before < 150 * 20_000
