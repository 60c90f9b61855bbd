"""Operators on hand-written rows: the edge cases that the given tables may not hold."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tributary.functions import arrays as A
from tributary.functions import derive as D
from tributary.operators import clean as C
from tributary.operators import graph as G
from tributary.operators import metrics as M
from tributary.operators import model as L
from tributary.operators import propagate as P
from tributary.operators import runs as R
from tributary.operators import sessions as S
from tributary.operators.prefix import ordered_prefix


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def log(spark, rows):
    return frame(spark, rows, "row_key long, user_id long, video_id long, time_ms long")


def test_ratio_and_ordinal(spark):
    df = frame(spark, [(1.0, 0.0, "full_active"), (None, 2.0, "UNKNOWN"), (5.0, 2.0, None), (-1.0, 2.0, "odd"), (1.0, 4.0, "middle_active")], "a double, b double, c string")
    got = [tuple(r) for r in df.select(D.clipped_ratio("a", "b"), D.ordinal("c")).collect()]
    assert got == [(0.0, 3), (0.0, 0), (1.0, 0), (0.0, 0), (0.25, 1)]


def test_tags_and_shapes(spark):
    df = frame(spark, [(" 3 , x,5", 4.0, 0.0), ("", None, 2.0), (None, 4.0, 2.0), ("7,7", None, None)], "t string, w double, h double")
    got = [tuple(r) for r in df.select(D.parse_tags("t"), D.aspect_ratio("w", "h"), D.seconds("w")).collect()]
    assert got == [([3, 5], 1.0, 0.004), ([], 1.0, 0.0), ([], 2.0, 0.004), ([7, 7], 1.0, 0.0)]


def test_weights_labels_clamp(spark):
    df = frame(spark, [(1, "1.0", 9), (0, "bad", -3), (None, None, 2)], "r int, y string, i int")
    got = [tuple(r) for r in df.select(D.ips_weight("r"), D.ips_weight("r", enabled=False), D.label("y"), D.clamp("i", 5)).collect()]
    assert got == [(1.0, 1.0, 1, 4), (0.9963, 1.0, 0, 0), (0.9963, 1.0, 0, 2)]


def test_prefix_is_global(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(2).alias("v")).repartition(5)
    out = ordered_prefix(df, [F.col("k")], rank="r", sums={"v": "s"})
    assert all(r.r == r.k and r.s == 2 * (r.k + 1) for r in out.collect())
    assert ordered_prefix(df.limit(0), [F.col("k")], rank="r").collect() == []
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_session_gap_is_strict(spark):
    rows = log(spark, [(1, 1, 10, 0), (2, 1, 11, 1_800_000), (3, 1, 12, 3_600_001), (4, 2, 10, 5), (5, 2, 10, 5)])
    assert values(S.sessionize(rows), "row_key", "session_id") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]


def test_session_tail_and_pairs(spark):
    rows = log(spark, [(k, 1, k, k) for k in range(51)] + [(100, 2, 7, 0)]).withColumn("tab", F.lit(1))
    s = S.sessionize(rows)
    assert S.session_tail(s, 50).where("user_id = 1").count() == 50
    pairs = S.next_in_session(s, most=50)
    assert pairs.count() == 49 and pairs.agg(F.min("src"), F.max("dst")).first() == Row(1, 50)
    assert values(S.last_items(pairs), "session_id", "last") == [(1, 50)]


def test_history_bounds(spark):
    rows = log(spark, [(k, 1, k, k) for k in range(52)] + [(99, 2, 1, 0)])
    sizes = {r.row_key: len(r.hist) for r in S.histories(rows).collect()}
    assert 0 not in sizes and 99 not in sizes and sizes[1] == 1 and sizes[50] == 50 and sizes[51] == 50


def test_splits_with_ties(spark):
    rows = log(spark, [(k, k % 3, 1, 5 if k in (7, 8) else k) for k in range(10)])
    split = {r.row_key: r.split for r in S.temporal_split(rows).collect()}
    assert sum(v == "train" for v in split.values()) == 8 and split[7] == split[8] == "train" and split[6] == split[9] == "test" or split[9] == "test"
    by = S.positional_split(rows).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in by} == {"train": 8, "valid": 1, "test": 1}
    stats = {r.split: (r.total, r.pos) for r in S.split_statistics(S.temporal_split(rows).withColumn("is_click", F.lit(1))).collect()}
    assert stats == {"ALL": (10, 10), "train": (8, 8), "test": (2, 2)}


def test_third_video_type_stays_in_the_log(spark):
    videos = frame(spark, [(1, "NORMAL"), (2, "AD"), (3, "UNKNOWN")], "video_id long, video_type string")
    kept, listed = C.filter_ads(log(spark, [(1, 1, 1, 0), (2, 1, 2, 0), (3, 1, 3, 0), (4, 1, 4, 0)]), videos)
    assert values(kept, "video_id") == [(1,), (3,), (4,)] and values(listed, "video_id") == [(1,)]


def test_active_users_count_standard_rows_only(spark):
    standard = log(spark, [(k, 1 if k < 9 else 2, 1, k) for k in range(19)])
    random = log(spark, [(100, 1, 1, 0)])
    assert values(C.unite_policies(standard, random, 10).groupBy("user_id", "is_rand").count(), "user_id", "is_rand", "count") == [(1, 1, 1), (2, 0, 10)]


def test_vocabulary_and_sequences(spark):
    tokens = frame(spark, [("a",), ("a",), ("b",), ("c",), ("c",), (None,)], "t string")
    vocab = C.vocabulary(tokens, "t")
    assert values(vocab, "token", "n", "idx") == [("a", 2, 1), ("c", 2, 2)]
    seqs = frame(spark, [(1, ["a", "b", "c"]), (2, []), (3, ["c"] * 60)], "k long, h array<string>")
    got = {r.k: r.s for r in C.encode_sequences(seqs, "k", "h", vocab, "s", 5).collect()}
    assert got == {1: [0, 0, 1, 0, 2], 2: [0] * 5, 3: [2] * 5}


def test_fills(spark):
    df = frame(spark, [("1", None), ("3", "x"), ("bad", "y"), (None, "z")], "n string, c string")
    got = C.fill_median(D.fill_unknown(df, ["c", "absent"]), ["n", "none"])
    assert values(got, "n", "c", "none") == [(1.0, "unknown", 0.0), (2.0, "y", 0.0), (2.0, "z", 0.0), (3.0, "x", 0.0)]
    scaled = C.minmax(frame(spark, [(0,), (10,), (None,)], "x int"), "x", "y", eps=0)
    assert values(scaled, "y") == [(0.0,), (0.0,), (1.0,)]


def test_clashing_features_are_renamed(spark):
    out = C.left_features(frame(spark, [(1, 2)], "k int, a int"), frame(spark, [(1, 5, 6)], "k int, a int, b int"), "k")
    assert out.columns == ["k", "a", "a_item", "b"] and tuple(out.first()) == (1, 2, 5, 6)


@pytest.fixture
def small_graph(spark):
    rows = frame(spark, [(1, 1, 10, 0, 1, 0, 1, 3), (2, 1, 11, 10, 0, 1, 0, None), (3, 2, 10, 5, 1, 0, 0, 1), (4, 9, 10, 5, 1, 0, 0, 1), (5, 1, 99, 20, 1, 0, 0, 1)], "row_key long, user_id long, video_id long, time_ms long, is_click int, is_follow int, is_rand int, tab int").withColumns({"play_ratio": F.lit(0.5), "long_view": F.lit(1)})
    users = frame(spark, [(1, 3.0), (2, None)], "user_id long, activity double")
    videos = frame(spark, [(10, 7, [1, 1, 2]), (11, None, []), (12, 8, [2])], "video_id long, author_id long, tag_list array<int>")
    return G.build_graph(S.sessionize(rows), users, videos, scope="all")


def test_graph_invariants(small_graph):
    count = {(r.kind, r.name): r.n for r in G.graph_summary(small_graph).collect()}
    assert count == {("node", "user"): 2, ("node", "video"): 3, ("node", "author"): 2, ("node", "category"): 2, ("node", "session"): 4, ("edge", "interacted"): 3, ("edge", "clicked"): 2, ("edge", "followed"): 1, ("edge", "made_by"): 2, ("edge", "tagged_as"): 4, ("edge", "next_in_session"): 1}
    assert {r.node_type for r in G.sequential_view(small_graph).nodes.collect()} == {"video", "session"}
    assert "session" not in {r.node_type for r in G.structural_view(small_graph).nodes.collect()}
    attr = small_graph.edges.where("rel = 'interacted'").select("attr", "is_rand").collect()
    assert all(len(r.attr) == 4 and isinstance(r.is_rand, bool) for r in attr)


def test_graph_follows_need_an_author(spark, small_graph):
    assert small_graph.edges.where("rel = 'follows'").count() == 0  # the followed video has no author


def test_graph_round_trip_and_offsets(spark, small_graph, tmp_path):
    calls = []
    make = lambda: calls.append(1) or small_graph
    for rebuild in (False, False, True):
        loaded = G.load_or_build(spark, str(tmp_path / "g"), make, rebuild)
    assert len(calls) == 2
    assert values(loaded.edges.groupBy("rel").count(), "rel", "count") == values(small_graph.edges.groupBy("rel").count(), "rel", "count")
    merged = G.merged_edges(small_graph).collect()
    assert all(r.src < 9 and r.dst < 9 for r in merged) and len(merged) == 8


def test_training_scope_leaks_nothing(spark):
    rows = S.temporal_split(log(spark, [(k, 1, 10, k) for k in range(10)])).withColumns({"play_ratio": F.lit(0.0), "long_view": F.lit(0), "tab": F.lit(0), "is_rand": F.lit(0), "is_follow": F.lit(0), "is_click": F.lit(1)})
    users, videos = frame(spark, [(1,)], "user_id long"), frame(spark, [(10, 1, [1])], "video_id long, author_id long, tag_list array<int>")
    s = S.sessionize(rows)
    n = {scope: G.build_graph(s, users, videos, scope=scope).edges.where("rel = 'clicked'").count() for scope in ("train", "all")}
    assert n == {"train": 8, "all": 10}


def test_edge_cap_is_repeatable(spark):
    edges = frame(spark, [("a" if k % 2 else "b", k, k + 1, None) for k in range(100)], "rel string, src long, dst long, seq long")
    one, two = (values(G.cap_edges(e, 7), "rel", "src") for e in (edges, edges.repartition(7)))
    assert one == two and len(one) == 14


# propagation against numpy


@pytest.fixture
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (6, 4))
    edges = [("r", 0, 1), ("r", 2, 1), ("q", 3, 1), ("q", 1, 4), ("r", 1, 4), ("r", 0, 1)]
    return x, edges, frame(spark, [(k, r.tolist()) for k, r in enumerate(x)], "idx long, emb array<double>"), frame(spark, edges, "rel string, src long, dst long")


def matrix(df):
    rows = sorted(df.collect(), key=lambda r: r.idx)
    return np.array([r.emb for r in rows])


def norm(x):
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)


def test_mean_layers(toy):
    x, edges, nodes, table = toy
    for _ in range(2):
        new = x.copy()
        for r in ("r", "q"):
            for d in range(6):
                if got := [x[s] for rel, s, t in edges if rel == r and t == d]:
                    new[d] += np.mean(got, 0)
        x = np.maximum(norm(new), 0)
    assert matrix(P.propagate_mean(nodes, table, 4, 2)) == pytest.approx(x)


def test_gated_sum(toy):
    x, edges, nodes, table = toy
    for _ in range(2):
        m = np.zeros_like(x)
        for _, s, t in edges:
            m[t] += x[s]
        x = 0.5 * x + 0.5 * np.tanh(x + m)
    assert matrix(P.propagate_sum(nodes, table, 4, 2)) == pytest.approx(x)


@pytest.mark.parametrize("scope", ["all", "type"])
def test_attention_in(toy, scope):
    x, edges, nodes, table = toy
    out = x.copy()
    for d in range(6):
        mine = [(r, s) for r, s, t in edges if t == d]
        if mine:
            score = np.array([x[s] @ x[d] / 2 for _, s in mine])
            top = np.array([max(sc for (q, _), sc in zip(mine, score, strict=True) if scope == "all" or q == r) for r, _ in mine])
            w = np.exp(score - top)
            out[d] += (w / w.sum()) @ np.array([x[s] for _, s in mine])
    assert matrix(P.propagate_attention_in(nodes, table, 4, scope)) == pytest.approx(out)


def test_attention_out(toy):
    x, edges, nodes, table = toy
    out = x.copy()
    for s in range(6):
        mine = [t for _, a, t in edges if a == s]
        if mine:
            w = np.exp([x[s] @ x[t] for t in mine])
            out[s] += (w / w.sum()) @ x[mine]
    assert matrix(P.propagate_attention_out(nodes, table, 4)) == pytest.approx(norm(out))


def test_session_readout_and_blend(spark, toy):
    x, _, nodes, _ = toy
    pairs = frame(spark, [(1, 1, 0, 2), (1, 2, 2, 3)], "session_id long, seq long, src long, dst long")
    sessions = frame(spark, [(1,), (2,)], "session_id long")
    out = P.session_readout(nodes, pairs, sessions, 4)
    got = {r.session_id: (r["att"], r["last"]) for r in out.collect()}
    items = x[[0, 2, 3]]
    w = np.exp(np.tanh(x[3] + items).sum(1))
    assert got[1][0] == pytest.approx((w / w.sum()) @ items) and got[1][1] == pytest.approx(x[3]) and got[2] == ([0.0] * 4, [0.0] * 4)
    learned = {r.session_id: r.emb for r in P.recency_blend(out, ([0.0] * 8, 0.0)).collect()}
    assert learned[1] == pytest.approx((np.array(got[1][0]) + x[3]) / 2)
    assert {r.session_id: r.emb for r in P.recency_blend(out, None).collect()}[1] == pytest.approx(got[1][0])


def test_projection(spark):
    nodes = frame(spark, [("user", 0, [1.0, -2.0]), ("user", 1, [None, 1.0]), ("other", 0, [1.0])], "node_type string, idx long, features array<double>")
    w = P.seeded_matrix(2, 3, 1)
    got = {r.idx: r.emb for r in P.project_nodes(nodes, {"user": w}).collect()}
    assert got[0] == pytest.approx(np.maximum(np.array([1, -2]) @ w, 0)) and got[1] == pytest.approx(np.maximum(w[1], 0)) and len(got) == 2


def test_path_counts_before_the_row_only(spark):
    rows = frame(spark, [(1, 1, 10, 0, 1), (2, 1, 11, 1, 1), (3, 1, 10, 2, 0), (4, 2, 10, 3, 1)], "row_key long, user_id long, video_id long, time_ms long, is_click int")
    authors = frame(spark, [(10, 5), (11, 5)], "video_id long, author_id long")
    tags = frame(spark, [(10, 1), (10, 2), (11, 2)], "video_id long, tag int")
    assert values(P.path_counts(rows, authors, tags), "row_key", "same_author", "same_category") == [(1, 0, 0), (2, 1, 1), (3, 2, 3), (4, 0, 0)]


# metrics


def brute_auc(y, s):
    pos, neg = [a for a, b in zip(s, y, strict=True) if b], [a for a, b in zip(s, y, strict=True) if not b]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, out, last = sum(y), 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        chosen = [b for a, b in zip(s, y, strict=True) if a >= cut]
        out += (sum(chosen) / total - last) * sum(chosen) / len(chosen)
        last = sum(chosen) / total
    return out


def brute_ndcg(y, s, k=10):
    def dcg(by):
        order, out, i = sorted(range(len(y)), key=lambda i: -by[i]), 0.0, 0
        while i < len(order):
            j = i
            while j < len(order) and by[order[j]] == by[order[i]]:
                j += 1
            out += np.mean([y[t] for t in order[i:j]]) * sum(1 / math.log2(p + 2) for p in range(i, j) if p < k)
            i = j
        return out

    return dcg(s) / dcg(y)


def test_metrics_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    users, y, s = rng.integers(0, 8, 300).tolist(), rng.integers(0, 2, 300).tolist(), (rng.integers(0, 12, 300) / 12).tolist()
    df = frame(spark, list(zip(users, y, s, strict=True)), "user_idx long, label int, score double")
    assert M.auc(df).first()[0] == pytest.approx(brute_auc(y, s))
    assert M.average_precision(df).first()[0] == pytest.approx(brute_ap(y, s))
    by = {u: ([b for a, b in zip(users, y, strict=True) if a == u], [c for a, c in zip(users, s, strict=True) if a == u]) for u in set(users)}
    want = [brute_ndcg(*v) for v in by.values() if len(v[0]) >= 2 and sum(v[0])]
    assert M.ndcg(df).first()[0] == pytest.approx(np.mean(want))
    row = M.evaluate_split(df, "test").first()
    assert row.n_samples == 300 and row.n_pos == sum(y) and row.auc == pytest.approx(brute_auc(y, s))


def test_metrics_of_one_class_and_of_equal_scores(spark):
    one = frame(spark, [(1, 1, 0.3), (1, 1, 0.4)], "user_idx long, label int, score double")
    assert tuple(M.evaluate_split(one, "x").first())[1:5] == (0.0, 0.0, 0.0, 0.0)
    same = frame(spark, [(1, 1, 0.5), (1, 0, 0.5)], "user_idx long, label int, score double")
    assert M.auc(same).first()[0] == 0.5 and M.average_precision(same).first()[0] == 0.5
    assert M.ndcg(frame(spark, [(1, 1, 0.5), (2, 0, 0.5)], "user_idx long, label int, score double")).first()[0] == 0.0


def test_weighted_loss_is_finite_and_capped(spark):
    df = frame(spark, [(1, 1000.0, 1e9), (0, -1000.0, 1.0), (1, 0.0, 10.0)], "label int, logit double, ips double")
    assert M.ips_log_loss(df).first()[0] == pytest.approx(10 * math.log(2) / 21)
    good, bad = (M.ips_log_loss(frame(spark, [(y, 3.0, 1.0)], "label int, logit double, ips double")).first()[0] for y in (1, 0))
    assert good < bad


def test_pivot_shows_what_is_missing(spark):
    df = frame(spark, [("a", "test", "auc", 0.5), ("a", "test", "ap", 0.25), ("b", "test", "auc", 0.75)], "model string, split string, metric string, value double")
    assert values(M.side_by_side(df), "metric", "a_test", "b_test") == [("ap", "0.2500", "N/A"), ("auc", "0.5000", "0.7500")]


def test_click_model_learns_a_planted_signal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 2))
    y = (x[:, 0] + 0.3 * rng.normal(0, 1, 600) > 0).astype(int)
    df = frame(spark, [(float(a), float(b), int(c), 1.0, [float(a), float(b)]) for (a, b), c in zip(x, y, strict=True)], "a double, b double, is_click int, ips double, v array<double>")
    for features in (["a", "b"], "v"):
        out = L.score(L.train_click_model(df, features, maxIter=10), df, features)
        assert M.auc(out.withColumnRenamed("is_click", "label")).first()[0] > 0.9
        assert out.where("score < 0 or score > 1").count() == 0


# runs


def test_runs(spark):
    t = "struct<auc:double,ap:double,logloss:double,ndcg10:double>"
    m = lambda a: None if a is None else (a, 0.1, 0.2, 0.3)
    history = frame(spark, [("x", 1, m(0.7)), ("x", 2, m(0.7)), ("x", 3, None), ("y", 1, m(0.9)), ("y", 2, (None, 0.1, 0.2, 0.3))], f"run string, epoch int, test {t}")
    assert values(R.last_epoch(history), "run", "epoch") == [("x", 2), ("y", 2)]
    assert values(R.best_epoch(history), "run", "best_epoch") == [("x", 1), ("y", 1)]
    assert values(R.convergence(history), "run", "epoch") == [("x", 1), ("x", 2)]
    assert values(R.deltas(R.last_epoch(history), "absent"), "run") == []
    name = R.parse_run_name(frame(spark, [("27k_dual_kg32_ips1_rg0_L3_h64d32",), ("1k_kgat_ips0",)], "run string")).drop("run").collect()
    assert tuple(name[0]) == ("27k", "dual", 32, 1, 0, 3, 64, 32, None) and tuple(name[1]) == ("1k", "kgat", None, 0, None, 2, 128, 64, None)


def test_vector_arithmetic(spark):
    df = frame(spark, [([3.0, -1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    row = df.select(A.dot(F.col("x"), F.col("y")).alias("d"), A.relu(F.col("x")).alias("r"), A.layer_norm(F.col("x"), 0.0).alias("n")).first()
    assert row.d == 1.0 and row.r == [3.0, 0.0] and row.n == [1.0, -1.0]
