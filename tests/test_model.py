"""The fitted head against its optimality conditions, and what boosted trees must satisfy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import model as L

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (400, 2)) * [1, 30]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.05] + 0.3)))).astype(int)
    w = rng.random(400) + 0.1
    rows = [(float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, y, w, strict=True)]
    return np.c_[x, np.ones(400)], y, w, spark.createDataFrame(rows, "a double, b double, is_click int, ips double")


def test_derivatives(data):
    x, y, w, rows = data
    at = np.array([0.4, -0.01, 0.1])
    p = 1 / (1 + np.exp(-x @ at))
    found = L.optimality(rows, NAMES, at[:2].tolist(), at[2])
    assert found.gradient == pytest.approx(x.T @ (w * (p - y)) / w.sum())
    assert found.hessian == pytest.approx((x * (w * p * (1 - p))[:, None]).T @ x / w.sum()) and not found.reached
    loss = lambda b: (w * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() / w.sum()
    steps = np.eye(3) * 1e-6
    assert found.gradient == pytest.approx([(loss(at + s) - loss(at - s)) / 2e-6 for s in steps], abs=1e-6)


def test_fitted_head_is_refined_to_the_optimum(data):
    *_, rows = data
    fitted = L.coefficients(L.train_click_model(rows, NAMES, maxIter=50))
    weights, intercept = L.refine(rows, NAMES, *fitted)
    assert L.optimality(rows, NAMES, weights, intercept).reached
    assert np.abs(L.optimality(rows, NAMES, weights, intercept).gradient).max() < 1e-9
    assert [*weights, intercept] == pytest.approx([*fitted[0], fitted[1]], abs=1e-3)
    far = L.refine(rows, NAMES, [0.0, 0.0], 0.0)
    assert [*far[0], far[1]] == pytest.approx([*weights, intercept], abs=1e-7)
    more = rows.unionByName(rows.limit(5).withColumn("is_click", F.lit(None).cast("int"))).withColumn("c", F.lit(None).cast("double"))
    same = L.refine(more, NAMES, [0.0, 0.0], 0.0)
    assert [*same[0], same[1]] == pytest.approx([*weights, intercept], abs=1e-7)
    flat = L.refine(more, [*NAMES, "c"], [0.0] * 3, 0.0)  # a column without values has no say
    assert flat[0][:2] == pytest.approx(weights, abs=1e-7)


def test_refined_heads_do_not_depend_on_the_start(data):
    """A start whose loss cannot fall by what counts still differs from the best head by more than rounding."""
    *_, rows = data
    best = L.refine(rows, NAMES, [0.0, 0.0], 0.0)
    near = [best[0][0] + 1e-9, best[0][1]], best[1] - 1e-9
    assert L.optimality(rows, NAMES, *near).reached
    found = L.refine(rows, NAMES, *near)
    assert [*found[0], found[1]] == pytest.approx([*best[0], best[1]], rel=0, abs=1e-13)


def test_fitted_scores_equal_sql_to_the_last_digit(spark):
    """At this size the fit itself is near enough to end the refinement at once."""
    import duckdb

    from tributary.plans import ORACLE_SQL, QUERIES

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("events", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = {k: v for k, *v in con.execute(ORACLE_SQL["click_model_scores"]).fetchall()}
    got = {k: v for k, *v in QUERIES["click_model_scores"](spark, sf).select("row_key", "is_click", "logit", "score").collect()}
    assert len(want) == 10000 and got.keys() == want.keys()
    assert [(k, got[k], want[k]) for k in want if got[k] != want[k]] == []


def test_separated_classes_have_no_optimum(spark):
    rows = spark.createDataFrame([(float(k), 0.0, int(k > 3), 1.0) for k in range(8)], "a double, b double, is_click int, ips double")
    with pytest.raises(ValueError, match="no optimum"):
        L.refine(rows, NAMES, [0.0, 0.0], 0.0, steps=8)
    with pytest.raises(ValueError, match="no row"):
        L.optimality(rows.limit(0), NAMES, [0.0, 0.0], 0.0)


def test_boosted_splits_lower_the_loss(data):
    """Every split of the first tree parts the weighted squared error of the labels, its leaves are weighted means."""
    x, y, w, rows = data
    head = L.train_click_model(rows, NAMES, kind="boosted", maxIter=2, maxDepth=1, stepSize=0.1, seed=1).stages[-1]
    tree = head.trees[0].toDebugString
    feature, cut = int(tree.split("feature ")[1].split(" ")[0]), float(tree.split("<= ")[1].split(")")[0])
    target = 2.0 * y - 1
    left = x[:, feature] <= cut
    error = lambda hit: (w[hit] * (target[hit] - np.average(target[hit], weights=w[hit])) ** 2).sum()
    assert error(left) + error(~left) < error(np.full(len(y), True))
    leaves = [float(v.split("\n")[0]) for v in tree.split("Predict: ")[1:]]
    assert leaves == pytest.approx([np.average(target[left], weights=w[left]), np.average(target[~left], weights=w[~left])])
