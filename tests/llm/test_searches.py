"""The searches on large components, varying norms, hot cells, clashing columns and many blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import metric_search, multi_index, vectors


def table(spark, x, ids=None):
    names = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(names, x, strict=True)], "vec_id long, embedding array<double>")


CLASHING = ("v", "part", "lane", "block", "root", "far", "cell", "norm2", "names", "score", "rank")


def exact(v, q, k):
    s = [sum(int(a) * int(b) for a, b in zip(x, v[q], strict=True)) for x in v]
    return sorted(((-t, i) for i, t in enumerate(s) if i != q))[:k]


def test_exact_search_with_large_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 6))
    x[50] *= 1e7
    x[200] *= 1e7
    x[250] = 1e13
    v = np.floor(1024 * x)
    params = metric_search.MTreeParams(page=16, tree_rows=64, roots=5, seed_rows=40, query_divisor=50)
    found = metric_search.top_inner_products(table(spark, x), params).collect()
    for q in range(0, 300, 50):
        got = [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        clip = lambda s: max(min(s, 2**63 - 1), -(2**63) + 1)
        full = [(clip(-t), i) for t, i in exact(v, q, 300)]
        assert got == [(i, s) for s, i in sorted(full, key=lambda y: (-y[0], y[1]))[:10]]


def test_exact_search_over_many_blocks_and_parts(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (600, 5)), np.repeat(rng.normal(0, 1, (1, 5)), 300, 0)]  # a third are copies
    params = metric_search.MTreeParams(page=16, tree_rows=64, roots=5, seed_rows=40, query_divisor=3, block=8)
    rows = table(spark, x).withColumns({c: F.lit("x") for c in CLASHING})
    found = metric_search.top_inner_products(rows, params).collect()
    v = np.floor(1024 * x).astype(np.int64)
    assert len(found) == 3000
    by = {}
    for r in found:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in range(0, 900, 3):
        s = v @ v[q]
        order = [k for k in np.lexsort((np.arange(900), -s)) if k != q][:10]
        assert [by[q][k] for k in range(1, 11)] == [(k, s[k]) for k in order]


@pytest.mark.parametrize("spread", [0.0, 0.3, 1.0])
def test_neighbours_of_vectors_of_varying_norm(spark, spread):
    """Norms are log-normal; two thousand rows are searched through the index like more would be."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2000, 32))
    x *= np.exp(spread * rng.normal(0, 1, 2000))[:, None] / np.linalg.norm(x, axis=1)[:, None]
    found = multi_index.approximate_neighbours(table(spark, x).withColumns({c: F.lit("x") for c in CLASHING}), multi_index.MultiIndexParams(part_rows=300, block=16)).collect()
    hits = []
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(x[r.vec_id] @ x[q]), abs=1e-9) for r in got)
        hits.append(len(set(np.argsort(-s)[:20]) & {r.vec_id for r in got}) / 20)
    assert 0.9 <= np.mean(hits)
    if spread == 1.0:
        assert np.mean(hits) < 1  # the walk ends before the last cell


def test_walks_end_early_on_clusters(spark):
    """The measured depth follows the data: clustered vectors need few entries."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(0, 1, (40, 16)), 50, 0) + rng.normal(0, 0.05, (2000, 16))
    one, two = (multi_index.Codebook.fit(h, 28, 12) for h in (x[:, :8], x[:, 8:]))
    cell = multi_index.nearest(x[:, :8], one.centroids) * len(two.centroids) + multi_index.nearest(x[:, 8:], two.centroids)
    sizes = np.bincount(cell, minlength=len(one.centroids) * len(two.centroids))
    a, b = one.dissimilarity(x[:, :8], 2.0), two.dissimilarity(x[:, 8:], 2.0)
    depths = [multi_index.depth_of(a[q], b[q], sizes, cell[np.argsort(-(x @ x[q]))[:20]]) for q in range(0, 2000, 50)]
    assert np.quantile(np.concatenate(depths), 0.95) < 400
    met = multi_index.cells_met(a[0], b[0], sizes, 2000)
    order = np.argsort((a[0][:, None] + b[0]).ravel(), kind="stable")
    assert met == [c for c in order.tolist() if sizes[c]]


def test_a_crowded_cell_is_dealt_over_parts(spark):
    x = np.r_[np.repeat([[1.0, 0.5, 0.2, 0.1]], 500, 0), np.random.default_rng(5).normal(0, 0.1, (100, 4))]
    found = multi_index.approximate_neighbours(table(spark, x), multi_index.MultiIndexParams(part_rows=50, query_divisor=100)).collect()
    for q in (0, 100, 200, 300, 400):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [k for k in range(21) if k != q][:20]


def test_a_walk_is_its_last_sum():
    """The cells whose sums do not exceed the cutoff are those that the heap met."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        a, b, sizes = rng.normal(0, 1, 9), rng.normal(0, 1, 7), rng.integers(0, 4, 63)
        met = multi_index.cells_met(a, b, sizes, 30)
        sums = (a[:, None] + b).ravel()
        assert sorted(met) == np.flatnonzero((sums <= multi_index.cutoff(a, b, sizes, 30)) & (sizes > 0)).tolist()


def test_blocks_of_queries_walk_like_single_ones():
    rng = np.random.default_rng(9)
    points = np.c_[np.floor(rng.normal(0, 40, (1500, 5))), np.zeros(1500)]
    points[700:900] = points[3]  # copies tie
    r2 = (points**2).sum(1).max()
    points[:, -1] = np.sqrt(r2 - (points[:, :-1] ** 2).sum(1))
    pages = metric_search.build(np.arange(1500), points, points[0], metric_search.MTreeParams(page=20, fanout=6))
    queries = points[:50].copy()
    queries[:, -1] = 0
    best = metric_search.Best(np.arange(50), 10, np.int64)
    metric_search.search(pages, points[0], metric_search._distances(points, points[0]).max(), queries, (queries**2).sum(1) + r2, 1e-3, best)
    v = points[:, :-1].astype(np.int64)
    for q in range(50):
        s = v @ v[q]
        assert best.ids[q].tolist() == [k for k in np.lexsort((np.arange(1500), -s)) if k != q][:10]


@pytest.mark.parametrize("counts", [(1, 1), (9, 2), (33, 40), (1000, 2000)])
def test_tiles_bound_both_sides(counts):
    parts, blocks = counts
    for tasks in (1, 16, 500):
        rows, columns = vectors.tile_counts(parts, blocks, 1 << 21, 1 << 17, tasks, 8 << 20)
        assert 1 <= rows <= parts and 1 <= columns <= blocks
        assert -(-parts // rows) <= 4 and -(-blocks // columns) <= 64
        assert rows * columns >= min(tasks, parts * blocks) // 2
    first, many, n = vectors.shared_out(np.array([0, 3, 50, 0, 2, 9]), 10)
    assert many.tolist() == [1, 1, 5, 1, 1, 1] and n == int((first + many).max()) and len(set(range(int(first[2]), int(first[2]) + 5)) & set(first[[0, 1, 3, 4, 5]].tolist())) == 0


def test_searches_of_nothing_and_without_queries(spark):
    none = table(spark, np.ones((3, 4)), [1, 2, 3])
    for f in (metric_search.top_inner_products, multi_index.approximate_neighbours):
        assert f(none).collect() == [] and f(none.limit(0)).collect() == []
    lone = table(spark, np.ones((1, 4)))
    for f in (metric_search.top_inner_products, multi_index.approximate_neighbours):
        assert f(lone).collect() == []
