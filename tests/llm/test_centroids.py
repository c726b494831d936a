"""Clusters against exact arithmetic on Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from loamgraph.llm.centroids import assign, centroid_clusters, cluster_report, nearest
from loamgraph.llm.common import stored

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int"


def brute(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        near = [place(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), n in zip(kept, near) if n == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *place(v)) for i, v in kept]
    own = {j: sum(d for _, d, n in found if n == j) for j in range(len(centroids))}
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((i, j, d, own[j], sum(own.values()), digest(j)) for i, d, j in found), key=repr)


def reported(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, 7) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cluster_report(frame, **options).collect()), key=repr)


def random_vectors(n, dims=64, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 5 - 2, 0.3) for _ in range(dims)]) for i in range(n)]


def test_clusters_equal_exact_arithmetic(spark):
    rows = random_vectors(150)
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (500, [0.0] * 64), (501, [0.0] * 64)]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [None] + [1.0] * 63), (604, [float("nan")] + [1.0] * 63), (605, [float("-inf")] + [1.0] * 63)]
    assert reported(spark, rows) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = random_vectors(7)
    assert reported(spark, rows) == brute(rows)
    assert reported(spark, []) == [] == reported(spark, [(1, None)])


def test_large_components_count_exactly_or_are_refused(spark):
    rows = random_vectors(30, dims=2, seed=3) + [(90, [3e6, 1.0]), (91, [3.1e6, 0.0]), (92, [-2e6, 0.0])]
    assert reported(spark, rows, k=5, dims=2) == brute(rows, k=5, dims=2)
    with pytest.raises(Exception, match="beyond 2\\*\\*80"):
        reported(spark, [(1, [3e38, 0.0]), (2, [0.0, 0.0])], k=1, dims=2)
    with pytest.raises(Exception, match="does not fit a long"):
        reported(spark, [(1, [3e10, 0.0]), (2, [0.0, 0.0])], k=1, rounds=0, dims=2)


def test_screening_loses_nothing_and_saves_comparisons():
    rng = np.random.default_rng(0)
    for scale, dims in ((3, 64), (200, 64), (1 << 26, 64), (50, 13)):
        c = rng.integers(-scale, scale + 1, (40, dims))
        x = np.r_[c[rng.integers(0, 40, 300)] + rng.integers(-scale // 8 - 1, scale // 8 + 2, (300, dims)), c[:5], (c[:5] + c[5:10]) // 2]
        best, distance, counts = nearest(x, c)
        every = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert best.tolist() == [min(range(40), key=lambda j: (row[j], j)) for row in every]
        assert distance.tolist() == every.min(axis=1).tolist()
        assert counts[2] < counts[0] / 5


def test_counts_of_screening_are_told(spark):
    frame = spark.createDataFrame(random_vectors(200), "vec_id long, embedding array<float>")
    centroids = centroid_clusters(frame, k=5)[1]
    kept = stored(frame.selectExpr("vec_id as id", "transform(embedding, x -> cast(floor(x * 256) as double)) as v"))
    row = assign(kept, centroids, counts=True).selectExpr("sum(pairs) as p", "sum(exact) as e").first()
    assert row.p == 1000 and row.e < 1000
