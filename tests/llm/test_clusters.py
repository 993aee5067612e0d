"""Clustering in a vantage-point tree against brute force."""

import hashlib
import math

import numpy as np
import pytest

from folioquery.llm import centroids

VECTORS = "vec_id long, embedding array<float>, cluster int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(3)


def brute(rows, clusters, rounds, length):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(means))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in set(of):
            mine = [v for (_, v), c in zip(kept, of) if c == k]
            means[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, means[k])).encode()).hexdigest())
                   for i, k, d in found), key=repr)


def run(spark, rows, **options):
    return sorted((tuple(r) for r in centroids.clustered(vectors(spark, rows), **options).collect()), key=repr)


@pytest.mark.parametrize("leaf", [1, 4, 100])
def test_equals_brute_force(spark, leaf):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(9, 8)) * 2
    rows = [(i, (middle[i % 9] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    assert run(spark, rows, clusters=20, rounds=3, length=8, leaf=leaf) == brute(rows, 20, 3, 8)


def test_ties_repeats_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    grid = [(i, [float(i % 3) / 256, float(i // 3 % 3) / 256]) for i in range(60)]  # many vectors between two centroids
    odd = [(100, None), (101, []), (102, [1.0]), (103, [nan, 1.0]), (104, [1.0, -inf]), (105, [None, 1.0]),
           (None, [1.0, 1.0]), (7, [9.0, 9.0]), (7, [9.0, 9.0]), (108, [-0.001, 0.0])]
    rows = grid + odd
    for clusters in (1, 5, 200):
        assert run(spark, rows, clusters=clusters, rounds=2, length=2) == brute(rows, clusters, 2, 2)
    assert run(spark, rows[:0], length=2) == []
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30, 0.0])], length=2)


def test_search_skips_centroids_but_no_nearest_one():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-5, 5, (60, 6)) + 400 * k for k in range(8)])
    rows = np.concatenate([points[rng.integers(0, len(points), 300)] + rng.integers(-9, 9, (300, 6)), points[:50]])
    for scale in (1, 1 << 17):  # the second one is beyond exact floating-point sums
        tree = centroids.VantageTree(points * scale)
        number, distance, computed = centroids.nearest_centroid(rows * scale, tree)
        every = ((rows[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all()  # argmin takes the first of equals
        assert (distance == every.min(axis=1) * scale * scale).all()
        assert computed < 0.5 * every.size
