"""Propagation with weights and directions against numpy; files that repeat rows; counts that stand in for built tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import clean as C
from tributary.operators import graph as G
from tributary.operators import propagate as P
from tributary.sources import logs, runs

N, WIDTH = 7, 4


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (N, WIDTH))
    edges = [("r" if k % 3 else "q", int(a), int(b)) for k, (a, b) in enumerate(rng.integers(0, N - 1, (15, 2)))]  # the last node has none
    w = {k: {r: rng.normal(0, 0.5, (WIDTH, WIDTH)) for r in "qr"} for k in ("a", "b", "c")}
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, emb array<double>")
    return x, edges, w, nodes, spark.createDataFrame(edges, "rel string, src long, dst long")


def got(df):
    return np.array([r.emb for r in sorted(df.collect(), key=lambda r: r.idx)])


@pytest.mark.parametrize("direction", ["in", "out"])
def test_mean_with_weights(toy, direction):
    x, edges, w, nodes, table = toy
    own = w["b"]["q"]
    want = x @ own
    for i in range(N):
        for r in "qr":
            near = [x[s] if direction == "in" else x[d] for rel, s, d in edges if rel == r and (d if direction == "in" else s) == i]
            if near:
                want[i] += np.mean(near, 0) @ w["a"][r]
    found = got(P.propagate_mean(nodes, table, WIDTH, layers=1, normalise=False, weights=w["a"], own=own, direction=direction))
    assert found == pytest.approx(want)


def test_sum_with_weights(toy):
    x, edges, w, nodes, table = toy
    m = w["a"]["r"]
    told = np.array([sum((x[d] for _, s, d in edges if s == i), np.zeros(WIDTH)) for i in range(N)]) @ m
    assert got(P.propagate_sum(nodes, table, WIDTH, weights=m, direction="out")) == pytest.approx(0.5 * x + 0.5 * np.tanh(x + told))


def test_attention_with_weights(toy):
    x, edges, w, nodes, table = toy
    want = x.copy()
    for i in range(N):
        near = [(np.exp(x[i] @ w["a"][r] @ (x[s] @ w["b"][r]) / np.sqrt(WIDTH)), x[s] @ w["c"][r]) for r, s, d in edges if d == i]
        if near:
            want[i] += sum(e * v for e, v in near) / sum(e for e, _ in near)
    assert got(P.propagate_attention_in(nodes, table, WIDTH, query=w["a"], key=w["b"], value=w["c"])) == pytest.approx(want)
    want = x.copy()
    for i in range(N):
        near = [(np.exp(x[i] @ w["a"][r] @ x[d]), x[d]) for r, s, d in edges if s == i]
        if near:
            want[i] += sum(e * v for e, v in near) / sum(e for e, _ in near)
    assert got(P.propagate_attention_out(nodes, table, WIDTH, normalise=False, weights=w["a"])) == pytest.approx(want)


def test_covisit_counts_a_pair_once(toy):
    x, edges, w, nodes, table = toy
    want = x.copy()
    for i in range(N):
        near = [(np.exp(x[i] @ w["a"]["q"] @ x[s] / np.sqrt(WIDTH)), x[s]) for s, d in {(s, d) for _, s, d in edges} if d == i]
        if near:
            want[i] += sum(e * v for e, v in near) / sum(e for e, _ in near)
    assert got(P.propagate_covisit(nodes, table.unionByName(table), WIDTH, query=w["a"]["q"])) == pytest.approx(want)


def test_readout_and_alignment_with_weights(spark, toy):
    x, _, w, nodes, _ = toy
    a, b, c = w["a"]["q"], w["b"]["q"], np.array([0.5, -1.0, 2.0, 0.25])
    pairs = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 2, 3), (1, 3, 3, 2)], "session_id long, seq long, src long, dst long")
    sessions = spark.createDataFrame([(1,), (2,)], "session_id long")
    found = {r.session_id: r for r in P.session_readout(nodes, pairs, sessions, WIDTH, (a, b, c)).collect()}
    e = {i: np.exp(np.tanh(x[2] @ a + x[i] @ b) @ c) for i in (0, 2, 3)}
    assert np.array(found[1].att) == pytest.approx(sum(v * x[i] for i, v in e.items()) / sum(e.values()))
    assert found[2].att == [0.0] * WIDTH and np.array(found[1]["last"]) == pytest.approx(x[2])
    rows = spark.createDataFrame([(x[0].tolist(), x[1].tolist())], "q array<double>, k array<double>")
    one = P.align_pairs(rows, "q", "k", ["k"], WIDTH, 2, {"q": a, "k": b}).first()
    q, k = x[0] @ a, x[1] @ b
    e = np.exp([q[:2] @ k[:2] / np.sqrt(2), q[2:] @ k[2:] / np.sqrt(2)])
    assert np.array(one.pair_vector) == pytest.approx(np.r_[k[:2] * e[0], k[2:] * e[1]] / e.sum())
    assert one.k == x[1].tolist()


def test_projection_looks_codes_up(spark):
    rng = np.random.default_rng(2)
    table, w = rng.normal(0, 1, (3, 2)), rng.normal(0, 1, (4, 5))
    nodes = spark.createDataFrame([("user", 0, [1.0, 2.0, 0.5]), ("user", 1, [1.0, 9.0, None]), ("user", 2, [None]), ("video", 0, [1.0])], "node_type string, idx long, features array<double>")
    found = {r.idx: np.array(r.emb) for r in P.project_nodes(nodes, {"user": w}, {"user": 0.1}, {"user": {1: table}}).collect()}
    for idx, (a, code, c) in {0: (1, 2, 0.5), 1: (1, 2, 0), 2: (0, 0, 0)}.items():
        assert found[idx] == pytest.approx(np.maximum(np.r_[a, c, table[code]] @ w + 0.1, 0))
    assert len(found) == 3


def test_repeated_periods_have_keys_of_their_own(spark, tmp_path):
    head = "user_id,video_id,time_ms,is_click,play_time_ms,duration_ms,tab"
    body = [f"1,{10 + k % 2},{1000 + k},1,500,1000,3" for k in range(11)]
    for name in ("log_standard_1_1k.csv", "log_standard_2_1k.csv"):
        (tmp_path / name).write_text("\n".join([head, *body]))
    (tmp_path / "log_random_1_1k.csv").write_text("\n".join([head, "1,10,1,0,1,1,1", "1,10,1,0,1,1,1"]))
    (tmp_path / "user_features_1k.csv").write_text("user_id,user_active_degree\n1,full_active\n")
    (tmp_path / "video_features_basic_1k.csv").write_text("video_id,author_id,video_type,tag\n10,5,NORMAL,1\n11,5,NORMAL,1\n")
    (tmp_path / "video_features_statistic_1k.csv").write_text("video_id,show_cnt,valid_play_cnt\n10,4,1\n")
    d = logs.load_dataset(spark, str(tmp_path))
    assert sorted(r.row_key for r in d.log.collect()) == list(range(24))
    tags = d.videos.select("video_id", F.explode("tag_list").alias("tag"))
    counts = P.path_counts(d.log, d.videos.select("video_id", "author_id"), tags).collect()
    assert sorted(r.same_author for r in counts) == sorted([0, 0, *range(22)])


def test_medians_of_ties_nulls_and_texts(spark):
    rows = [("1", None), ("x", 2.0), ("3", 2.0), ("3", None), (None, 7.0), ("10", 1.0)]
    df = spark.createDataFrame(rows, "a string, b double").withColumn("c", F.lit(None).cast("string"))
    filled = C.fill_median(df, ["a", "b", "c", "absent"]).collect()
    assert sorted(r.a for r in filled) == [1.0, 3.0, 3.0, 3.0, 3.0, 10.0] and sorted(r.b for r in filled) == [1.0, 2.0, 2.0, 2.0, 2.0, 7.0]
    assert {r.c for r in filled} == {None} and {r.absent for r in filled} == {0.0}
    assert C.fill_median(df.limit(0), ["a"]).collect() == []


def test_edge_cap_equals_a_sort(spark):
    rows = [("r", k % 40, k % 7, k) for k in range(3000)] + [("s", 1, 1, None)] * 50 + [("t", 1, 2, 3)]
    edges = spark.createDataFrame(rows, "rel string, src long, dst long, seq long")
    order = F.md5(F.concat_ws("|", F.lit(42), "src", "dst", F.coalesce(F.col("seq"), F.lit(-1))))
    for most in (5, 100):
        found = [tuple(r) for r in G.cap_edges(edges, most).collect()]
        want = [tuple(r) for rel in "rst" for r in edges.where(F.col("rel") == rel).orderBy(order, "src", "dst").limit(most).collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)
    assert G.cap_edges(edges.limit(0)).collect() == []


def test_counts_stand_in_for_the_built_graph(spark):
    from tributary.plans import bind as B
    from tributary.plans.graph import sessions

    sf = "/root/testdata/sf0.001"
    parts = sessions(spark, sf), B.users(spark, sf), B.videos(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(G.graph_counts(*parts)) == rows(G.graph_summary(G.build_graph(*parts, scope="all")))


def test_fallbacks_of_predictions(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, y int")
    fit = spark.createDataFrame([(1, 0.25), (2, 0.5), (3, 0.75)], "id long, p double")
    log = spark.createDataFrame([(0.75, 0.5)], "auc double, logloss double")
    row = lambda p, x: tuple(runs.split_metrics(p, labels, "id", "y", x).select("auc", "n_samples", "n_pos").first())
    assert row(fit, log) == (1.0, 3, 2) and row(fit.limit(2), log) == (0.75, 3, 2) and row(None, None) == (None, 3, 2)
