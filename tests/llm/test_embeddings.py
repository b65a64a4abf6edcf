"""Whitening and pivot clustering against plain versions in exact arithmetic."""

import hashlib
from fractions import Fraction

import numpy as np

from versewise.llm import pivot_clusters as pc
from versewise.llm import whitening as wh

VECTORS = "vec_id long, embedding array<float>, label int"


def _rows(n: int, dims: int, seed: int = 0) -> list:
    x = np.random.default_rng(seed).normal(0, 0.4, (n, dims)).astype(np.float32)
    x[: n // 3] = x[0]  # a third of the rows are one vector
    return [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]


BAD = [(900, None, 1), (901, [], 1), (902, [1.0, None], 1), (903, [float("nan"), 1.0], 1), (904, [float("inf"), 1.0], 1)]


def test_whitening_equals_exact_covariance(spark):
    rows = _rows(120, 5) + BAD + [(7, [0.5] * 5, 1), (7, [0.5] * 5, 1), (None, [-0.25] * 5, 1)]
    out = wh.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    kept = [(r[0], [int(np.floor(256 * float(np.float32(v)))) for v in r[1]]) for r in rows if r[1] and len(r[1]) == 5]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(x[d] for x in fit) for d in range(5)]
    assert {r.n for r in out} == {n} and len(out) == 4 * len(kept)
    v = np.array([[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3)) for j in range(5)] for i in range(5)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    want = {}
    for key, x in kept:
        w = (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)
        want.setdefault((key, sum((n * a - b) ** 2 for a, b in zip(x, s))), []).append(np.abs(w[:4]))
    for r in out:
        assert any(abs(abs(r.whitened) - w[r.component - 1]) < 1e-9 for w in want[r.vec_id, r.deviation])
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-9
    first = [r for r in out if r.vec_id == 1]
    assert {r.component for r in first} == {1, 2, 3, 4}


def test_polarised_squares_are_exact_for_large_entries(spark):
    rows = [([2**40 + i, -(2**41) - 3 * i, i * i],) for i in range(9)] + [([2**62, -(2**62), 2**62 - 1],)]
    n, s, cubed = wh.polarised_covariance(spark.createDataFrame(rows, "x array<bigint>"), 3)
    x = [r[0] for r in rows]
    assert n == 10 and s == [sum(c) for c in zip(*x)]
    assert cubed == [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) for j in range(3)] for i in range(3)]
    y = np.array([[2**60, -(2**60) + 1, 123456789012345]] * 4)
    assert wh.sum_of_squares(y) == [4 * int(v) ** 2 for v in y[0]]


def test_whitening_of_few_vectors_has_null_components(spark):
    assert wh.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert wh.whiten(spark.createDataFrame(BAD[:1] + BAD[2:], VECTORS)).collect() == []
    one = wh.whiten(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], VECTORS)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.identity_error is None for r in one)
    two = wh.whiten(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [1.5, 0.5], 0)], VECTORS)).collect()
    assert sorted((r.component, None if r.whitened is None else round(abs(r.whitened), 9)) for r in two) == [(1, 1.0), (1, 1.0), (2, None), (2, None)]
    huge = wh.whiten(spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0)], VECTORS)).collect()
    assert all(r.deviation is None for r in huge)


def _plain_clusters(rows, k=16, rounds=3):
    x = [(i, [int(np.floor(64 * float(np.float32(v)))) for v in e]) for i, e, _ in rows if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    c = [v for _, v in sorted(x, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in x]
        c = [[sum(t) // len(t) for t in zip(*mine)] if (mine := [v for (_, v), o in zip(x, own) if o == j]) else m for j, m in enumerate(c)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in x), c


def test_clusters_equal_all_distances(spark):
    rows = _rows(150, 64) + BAD + [(910, [0.1] * 63, 0), (911, [0.2] * 64, 0), (911, [0.2] * 64, 0), (912, [1e7] * 64, 0)]
    out = pc.pivot_clusters(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want, centroids = _plain_clusters(rows)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == want
    assert all(list(r.centroid) == centroids[r.cluster] for r in out)
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)}
    for r in out:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)


def test_pivot_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(4)
    middle = rng.integers(-60, 60, (16, 64))
    x = middle[rng.integers(0, 16, 2000)] + rng.integers(-2, 3, (2000, 64))
    pivots = x[:8]
    far = np.stack([np.sqrt(pc.squared_distances(x, p).astype(float)) for p in pivots], 1)
    which, best, done = pc.nearest_centroids(x, far, middle, pivots)
    every = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (best == every.min(1)).all() and done < 0.5 * every.size


def test_clusters_of_few_vectors_and_of_none(spark):
    assert pc.pivot_clusters(spark.createDataFrame([], VECTORS)).collect() == []
    one = pc.pivot_clusters(spark.createDataFrame([(5, [0.3] * 64, 1)] * 2, VECTORS)).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in one] == [(0, 0, 0)] * 2
    huge = pc.pivot_clusters(spark.createDataFrame([(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1)], VECTORS), k=1).collect()
    assert len(huge) == 3
