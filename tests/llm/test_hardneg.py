"""Operator 11 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from runloom.llm import hardneg as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def model(rows, every=100):
    """All pairs, in Python's integers."""
    v = []
    for n, (vid, x, label) in enumerate(rows):
        if vid is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((n, vid, (label + 1) % 10 if vid % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for n, vid, label, x in v:
        if vid % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(x, y)), oid, m, other) for m, oid, other, y in v if m != n and len(y) == len(x))
        for p, pid, _, other in [r for r in s if r[3] == label][:5]:
            good = [r for r in s if r[3] != label and 80 * -p <= 100 * -r[0] <= 100 * -p][:5]
            out += [(vid, pid, i + 1, r[1], -p, -r[0]) for i, r in enumerate(good)]
    return sorted(out)


def mined(spark, rows, every=100):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("dims", F.lit(3)).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in H.hard_negatives(d, F.col("vec_id") % every == 0, label).collect())


def clustered(n, dims=8, clusters=12, seed=1, noise=0.25):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((clusters, dims))
    at = rng.integers(0, clusters, n)
    x = c[at] + noise * rng.standard_normal((n, dims))
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, 3) if i % 3 else at[i] % 10)) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rows = clustered(1300)
    want = model(rows, 20)
    assert want and mined(spark, rows, 20) == want
    # Small leaves and many cells, so that nodes and cells are pruned.
    monkeypatch.setattr(H.np, "clip", lambda *a: 60)
    assert mined(spark, rows, 20) == want


def test_ties_repeats_nulls_and_lengths(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(i, one, i % 2) for i in range(40)] + [(i, one, i % 2) for i in range(10)]
    rows += [(None, one, 1), (50, None, 1), (51, [1.0, None, 2.0], 1), (52, [math.nan, 1.0, 1.0], 0), (53, [math.inf, 1.0, 1.0], 0), (54, one, None)]
    rows += [(60, [], 1), (61, [], 0), (62, [], 1), (80, [1.0, 2.0], 3), (81, [1.0, 2.0], 3), (82, [1.0, 1.9], 4), (83, [-1.0, 2.0], 4), (100, [-1.0, -1.0, -1.0], 1), (101, [0.0, 0.0, 0.0], 5)]
    assert mined(spark, rows, 20) == model(rows, 20)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in 3e5 * rng.standard_normal(6)], i % 2) for i in range(120)]
    assert mined(spark, rows, 20) == model(rows, 20)
    # Too large for a long: takes no part.
    assert mined(spark, [*rows, (500, [3e38] * 6, 1)], 20) == model(rows, 20)


def test_empty(spark, sample):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(2)
    c = rng.standard_normal((40, 16)) * 300
    x = np.rint(np.repeat(c, 100, axis=0) + 8 * rng.standard_normal((4000, 16))).astype(np.int32)
    labels = rng.integers(0, 4, 4000)
    tree = H.BallTree(x, np.arange(4000), np.arange(4000), labels, leaf=32)
    for node, (lo, hi) in enumerate(zip(tree.lo, tree.hi)):
        q = x[::400].astype(float)
        up, down = H.bounds(q, np.sqrt((q * q).sum(axis=1)), tree.center, tree.radius)
        s = q @ tree.x[lo:hi].T.astype(float)
        assert (s.max(axis=1) <= up[:, node]).all() and (s.min(axis=1) >= down[:, node]).all()
    q, rows = x[::40], np.arange(0, 4000, 40)
    score = q.astype(np.int64) @ x.T.astype(np.int64)
    top = np.sort(np.where((labels[rows][:, None] == labels) & (rows[:, None] != np.arange(4000)), score, H.LOW), axis=1)[:, ::-1][:, :5]
    one = lambda v: np.full((len(q), 1), v)
    found, made = H.search(tree, q, rows, labels[rows], one(H.LOW), one(H.HIGH), one(H.LOW), True)
    assert (found.score == top).all() and made < 0.25 * score.size
    # A floor and a narrow window leave less to look at.
    high = score.max(axis=1)[:, None]
    found, fewer = H.search(tree, q, rows, labels[rows], high - high // 5, high, one(H.LOW), False)
    assert fewer < 0.25 * score.size
    ok = (labels[rows][:, None] != labels) & (score >= high - high // 5) & (score <= high)
    assert (found.score == np.sort(np.where(ok, score, H.LOW), axis=1)[:, ::-1][:, :5]).all()


@pytest.mark.parametrize("p", [-7, -5, -1, 0, 1, 4, 5, 6, 99, 100, 101])
def test_windows(p):
    inside = {n for n in range(-200, 200) if 80 * p <= 100 * n <= 100 * p}
    assert inside == set(range(p - p // 5, p + 1))
