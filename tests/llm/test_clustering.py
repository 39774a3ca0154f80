import hashlib
import math

import numpy as np
import pytest

from shoplens.llm import clustering
from shoplens.llm.clustering import Block, centroid_clusters, nearest

SCHEMA = "vec_id long, embedding array<float>, cluster string, id string, changes string, ids string, distance string"


def brute(rows, k, rounds, dims):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        scored = [[(sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)] for _, v in good]
        return [min(s) for s in scored]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(good, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    top = (1 << 63) - 1
    inertia = [sum(d for d, c in found if c == j) for j in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, top), min(inertia[c], top), min(sum(inertia), top), hashes[c]) for (i, _), (d, c) in zip(good, found)), key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, *"abcde") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroid_clusters(df, **kw).collect()), key=str)


@pytest.mark.parametrize("rounds", [0, 1, 3, 6])
def test_equals_brute_force_with_ties_and_copies(spark, rounds, monkeypatch):
    rng = np.random.default_rng(rounds)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(150)] + rows[:20]
    assert found(spark, rows, k=7, rounds=rounds, dims=4) == brute(rows, 7, rounds, 4)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [3.0]), (6, []), (0, [1.0, 2.0])]
    assert found(spark, rows, k=5, dims=2) == brute(rows, 5, 3, 2)
    assert found(spark, rows[1:5], k=5, dims=2) == []


@pytest.mark.parametrize("size", [1e4, 1e6, 1e12, 1e36])
def test_wide_components(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * size).astype(np.float32).tolist()) for i in range(60)]
    assert found(spark, rows, k=4, dims=3) == brute(rows, 4, 3, 3)


def test_only_expired_vectors_are_compared(monkeypatch):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-20, 20, (500, 8)) + 400 * j for j in range(4)])
    centroids = np.array([np.full(8, 400 * j) for j in range(4)])
    changes = np.zeros((4, 9), object)
    block = Block.new(list(range(2000)), values, centroids, changes)
    assert changes[:, 0].tolist() == [500] * 4
    assert (changes[:, 1:].astype(int) == [values[500 * j : 500 * (j + 1)].sum(0) for j in range(4)]).all()
    moved = centroids + 3
    drifts = clustering._drift(centroids.tolist(), moved.tolist())
    assert block.move(moved, drifts, changes) == 0  # clusters lie far apart
    far = centroids.copy()
    far[0] += 375
    drifts = [a + b for a, b in zip(drifts, clustering._drift(moved.tolist(), far.tolist()))]
    assert 0 < block.move(far, drifts, changes) < 2000
    assert (block.distances(far)[0] == nearest(values, far)[0]).all()


def test_blocks_travel_unchanged():
    for scale in (1, 1000, 1 << 20, 1 << 70):
        values = np.array([[1, -2], [3, 4]], object) * scale
        values = values if scale == 1 << 70 else values.astype(np.int64)
        block = Block.new([5, None], values, values[:1], np.zeros((1, 3), object))
        copy = Block.from_row(block.to_arrow().to_pylist()[0], 2)
        assert copy.ids == block.ids and (copy.values == block.values).all() and copy.heaps == block.heaps
