"""Block products and softmax states against numpy; a hub's edges lie in many tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import blocks
from tributary.operators import propagate as P
from tributary.operators.store import find_hubs

WIDTH = 4


def vectors(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "idx long, emb array<double>")


def test_turn(spark):
    rng = np.random.default_rng(1)
    x, a, b = rng.normal(0, 1, (6, WIDTH)), rng.normal(0, 1, (WIDTH, WIDTH)), rng.normal(0, 1, (WIDTH, 2))
    rows = [(k, r, None if k == 5 else x[k].tolist()) for k, r in enumerate(["a", "b", "a", None, "", "a"])]
    df = spark.createDataFrame(rows, "idx long, rel string, emb array<double>")
    found = {r.idx: r.emb for r in blocks.turn(df, "emb", {"a": a}).collect()}
    assert found[5] is None
    for k in range(5):
        assert found[k] == pytest.approx(x[k] @ a if rows[k][1] == "a" else x[k])
    wide = blocks.turn(df.where("idx < 5"), "emb", b, "small").collect()
    assert all(np.array(r.small) == pytest.approx(x[r.idx] @ b) and r.emb == x[r.idx].tolist() for r in wide)
    assert blocks.turn(df.limit(0), "emb", b).collect() == [] and blocks.turn(df, "emb", None) is df
    assert blocks.turn(df, "emb", None, "copy").columns == ["idx", "rel", "emb", "copy"]


def test_states_merge_in_any_order():
    """Split over batches and tasks in any way, the states of a node give the same softmax, large scores included."""
    rng = np.random.default_rng(2)
    n = 500
    idx, rel, score, v = rng.integers(0, 7, n), rng.integers(0, 2, n), rng.normal(0, 400, n), rng.normal(0, 1, (n, WIDTH))
    whole = blocks._States.merged(idx, rel, score, np.ones(n), v)
    for cuts in ([100, 101, 400], list(range(1, n)), rng.integers(0, n, 9).tolist()):
        tasks = [blocks._States(keep=10) for _ in range(3)]
        out = []
        for k, part in enumerate(np.split(np.arange(n), sorted(cuts))):
            if len(part) and (full := tasks[k % 3].add(idx[part], rel[part], score[part], np.ones(len(part)), v[part])):
                out.append(full)
        out += [rest for t in tasks if (rest := t.rest())]
        got = blocks._States.merged(*map(np.concatenate, zip(*out, strict=True)))
        assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all() and got[2] == pytest.approx(whole[2])
        assert got[4] / got[3][:, None] == pytest.approx(whole[4] / whole[3][:, None])


@pytest.fixture(scope="module")
def star(spark):
    """Every node points to node 0 in one of two relations, some to others; node 0 points back to a few."""
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(0, 1, (n, WIDTH))
    edges = [("ab"[k % 2], k, 0) for k in range(1, n)] * 2 + [("a", k, k % 50 + 1) for k in range(1, n)] + [("b", 0, k) for k in range(1, 40)]
    table = spark.createDataFrame(edges, "rel string, src long, dst long")
    return x, edges, vectors(spark, x), table


def brute(x, edges, to, scale, weights=None, scope="all"):
    out = x.copy()
    by = {}
    for r, s, d in edges:
        here, there = (d, s) if to == "dst" else (s, d)
        m = (weights or {}).get(r, np.eye(WIDTH))
        by.setdefault(here, []).append((r, x[here] @ m @ x[there] / scale, x[there]))
    for i, near in by.items():
        top = {r: max(s for q, s, _ in near if q == r or scope == "all") for r, _, _ in near}
        e = np.array([np.exp(s - top[r]) for r, s, _ in near])
        out[i] += e @ np.array([v for *_, v in near]) / e.sum()
    return out


@pytest.mark.parametrize("hub_rows", [100, 10**6])
@pytest.mark.parametrize("scope", ["all", "type"])
def test_attention_of_a_hub(star, hub_rows, scope):
    x, edges, nodes, table = star
    found = P.propagate_attention_in(nodes, table, WIDTH, max_scope=scope, hub_rows=hub_rows).collect()
    want = brute(x, edges, "dst", np.sqrt(WIDTH), scope=scope)
    assert np.array([r.emb for r in sorted(found)]) == pytest.approx(want)
    if scope == "all":
        m = {"a": np.random.default_rng(4).normal(0, 1, (WIDTH, WIDTH))}
        found = P.propagate_attention_out(nodes, table, WIDTH, normalise=False, weights=m, hub_rows=hub_rows).collect()
        assert np.array([r.emb for r in sorted(found)]) == pytest.approx(brute(x, edges, "src", 1.0, m))


def test_hub_is_dealt_evenly(spark, star):
    """With its edges dealt over parts no task meets many more of a hub's edges than another."""
    _, edges, nodes, table = star
    hubs = find_hubs(table, 100)
    assert set(hubs["dst"]) == {0} and hubs["dst"][0] == -(-5998 // 100) and hubs["src"] == {}
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "16"), strict=True):
        spark.conf.set(k, v)
    try:
        met = P._with_end(table, nodes, "dst", "q", hubs["dst"]).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in met.groupBy("task").count().collect()]
        assert sum(tasks) == len(edges) and max(tasks) < 2.5 * len(edges) / 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_shuffle_of_edges_an_end(star):
    """Edges move once to meet each end; what moves on are states."""
    *_, nodes, table = star
    plan = P._attention(nodes, table, WIDTH, "dst", "all", True)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 2 and plan.count("MapInArrow") == 1
