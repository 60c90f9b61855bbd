"""Edges that lie by an end stay there: layers, hubs, gates and saved graphs."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import graph as G
from tributary.operators import propagate as P
from tributary.operators.store import EdgeStore, bucketed, edge_store

WIDTH, N = 4, 60


@pytest.fixture(scope="module")
def net(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (N, WIDTH))
    edges = [("ab"[k % 2], int(s), int(d)) for k, (s, d) in enumerate(rng.integers(0, N - 1, (300, 2)))] + [("a", 0, k) for k in range(1, N - 1)] * 3
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "idx long, emb array<double>")
    return x, edges, nodes, spark.createDataFrame([*edges, ("a", None, 3), ("a", 3, None)], "rel string, src long, dst long")


def values(df):
    return np.array([r.emb for r in sorted(df.collect())])


def mean_layer(x, edges):
    out = x.copy()
    for i in range(N):
        for r in "ab":
            near = [x[s] for q, s, d in edges if d == i and q == r]
            if near:
                out[i] += np.mean(near, 0)
    return out


def test_layers_over_a_store(net):
    x, edges, nodes, table = net
    want = mean_layer(mean_layer(mean_layer(x, edges), edges), edges)
    assert values(P.propagate_mean(nodes, table, WIDTH, layers=3, normalise=False)) == pytest.approx(want)
    store = edge_store(table, "src", hub_rows=20)
    assert store.hubs[0] > 3
    assert values(P.propagate_mean(nodes, store, WIDTH, layers=3, normalise=False)) == pytest.approx(want)


def test_edges_stay_where_they_lie(spark, net):
    """The join with vectors moves no edges: of its two sides only the vectors' has an exchange."""
    *_, nodes, table = net
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for store in (edge_store(table, "src", hub_rows=20), edge_store(table, "src")):
            plan = store.with_vectors(nodes, "v")._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning\(src", plan)) == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hub_lies_in_many_buckets(spark, net):
    *_, table = net
    more = table.unionByName(spark.range(4000).select(F.lit("b").alias("rel"), F.lit(0).cast("long").alias("src"), "id").withColumnRenamed("id", "dst"))
    store = edge_store(more, "src", hub_rows=100, buckets=16)
    rows = [r["count"] for r in store.edges.groupBy(F.input_file_name()).count().collect()]
    assert len(rows) == 16 and max(rows) < 2.5 * sum(rows) / 16


def test_attention_over_a_store(net):
    x, edges, nodes, table = net
    want = values(P.propagate_attention_in(nodes, table, WIDTH))
    assert values(P.propagate_attention_in(nodes, edge_store(table, "src", hub_rows=20), WIDTH, hub_rows=20)) == pytest.approx(want)
    with pytest.raises(ValueError, match="must lie by that end"):
        P.propagate_attention_out(nodes, edge_store(table, "src"), WIDTH)


def test_store_of_nothing(net):
    x, _, nodes, table = net
    store = edge_store(table.limit(0), "src")
    assert isinstance(store, EdgeStore) and values(P.propagate_mean(nodes, store, WIDTH, layers=2, normalise=False)) == pytest.approx(x)


def test_gates(net):
    x, edges, nodes, table = net
    rng = np.random.default_rng(8)
    g = P.Gates(*[rng.normal(0, 0.5, (WIDTH, WIDTH)) for _ in range(6)], *[rng.normal(0, 1, WIDTH) for _ in range(3)])
    w = rng.normal(0, 0.1, (WIDTH, WIDTH))
    h = x
    for _ in range(2):
        m = np.array([sum((h[s] for _, s, d in edges if d == i), np.zeros(WIDTH)) for i in range(N)]) @ w
        new = []
        for own, told in zip(h, m, strict=True):
            z = 1 / (1 + np.exp(-(told @ g.wz + own @ g.uz + g.bz)))
            r = 1 / (1 + np.exp(-(told @ g.wr + own @ g.ur + g.br)))
            new.append((1 - z) * own + z * np.tanh(told @ g.wh + (r * own) @ g.uh + g.bh))
        h = np.array(new)
    assert values(P.propagate_sum(nodes, table, WIDTH, steps=2, gate=g, weights=w)) == pytest.approx(h)


def test_saved_graph_joins_without_exchange(spark, tmp_path):
    nodes = spark.createDataFrame([(t, k, [float(k)]) for t in ("user", "video") for k in range(20)], "node_type string, idx long, features array<double>")
    edges = spark.createDataFrame([("user", "clicked", "video", k % 20, k % 7, None, None, None, None) for k in range(100)], "src_type string, rel string, dst_type string, src long, dst long, attr array<double>, is_rand boolean, session_id long, seq long")
    G.save_graph(G.Graph(nodes, edges), str(tmp_path / "g"))
    G.save_graph(G.Graph(nodes, edges), str(tmp_path / "g"))
    loaded = G.load_graph(spark, str(tmp_path / "g"))
    assert sorted(map(repr, loaded.edges.collect())) == sorted(map(repr, edges.collect())) and loaded.nodes.count() == 40
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = loaded.edges.join(loaded.nodes.select(F.col("node_type").alias("src_type"), F.col("idx").alias("src"), "features"), ["src_type", "src"])
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed")] == []


def test_bucketed_keeps_rows(spark):
    df = spark.range(100).select(F.col("id"), F.array("id").alias("a"), F.struct("id").alias("s"), F.lit(None).cast("string").alias("n"))
    assert sorted(bucketed(df, "t", ["id"]).collect()) == sorted(df.collect())
