"""Clusters against plain distances in Python integers, and the transform's own properties."""

import hashlib
import math
import random

import numpy as np
import pytest

from massweave.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int, n int"


def brute(rows, k=40, rounds=5, seed=2):
    """(vec_id, cluster, distance, cluster inertia, inertia, check sum) of every kept row."""
    kept = [(i, e) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in kept]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), [float(y) for y in e], x) for (i, e), (_, x) in zip(kept, v) if i is not None)[:k]
    c = [x for _, _, x in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        of = [near(x)[1] for _, x in v]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(v, of) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    end = [near(x) for _, x in v]
    per = {j: sum(d for d, o in end if o == j) for j in range(len(c))}
    return sorted((i is not None, i or 0, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                  for (i, _), (d, j) in zip(v, end))


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, "c", 1, 1) for i, e in rows], SCHEMA).repartition(3)
    return sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in clusters.digest(df, **kw).collect())


def vectors(n, spread=1.0, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(64)]) for i in range(n)]


def test_transform_keeps_distances():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-2000, 2000, (2, 30, 64))
    assert (clusters.H @ clusters.H.T == 64 * np.eye(64, dtype=int)).all()
    assert (((clusters.transform(a) - clusters.transform(b)) ** 2).sum(1) == 64 * ((a - b) ** 2).sum(1)).all()
    assert (np.diff((np.diff(clusters.H, axis=1) != 0).sum(1)) > 0).all()          # coarse to fine


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(3)
    v, c = rng.integers(-2, 3, (300, 64)), rng.integers(-2, 3, (25, 64))
    c[7] = c[3]
    v[:25] = c
    which, dist = clusters.nearest(clusters.transform(v), clusters.transform(c))
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (which == d.argmin(1)).all() and (dist == d.min(1)).all()


@pytest.mark.parametrize("k", [3, 40])
def test_clusters_match_brute_force(spark, k):
    rows = vectors(150)
    assert got(spark, rows, k=k) == brute(rows, k=k)


def test_bad_rows_copies_and_ties(spark):
    good = vectors(20, seed=5)
    rows = good + [good[0]] * 30 + [(None, good[1][1]), (100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, []), (104, [None] + [1.0] * 63),
                                    (105, [float("nan")] + [1.0] * 63), (106, [float("-inf")] + [1.0] * 63), (107, [0.0] * 64), (107, [0.0] * 64)]
    assert got(spark, rows, k=8) == brute(rows, k=8)


def test_fewer_vectors_than_clusters(spark):
    rows = vectors(5, seed=6)
    assert got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = vectors(30, seed=7) + [(200 + i, [x * 1e5 for x in e]) for i, e in vectors(30, seed=8)] + [(300, [1e40] * 64)]
    assert got(spark, rows, k=6) == brute(rows[:-1], k=6)


def test_distance_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(i, e, "c", 1, 1) for i, e in vectors(10, seed=9) + [(50, [1e12] * 64)]], SCHEMA)
    r = {x.vec_id: x for x in clusters.digest(df, k=1, rounds=0).collect()}
    assert len(r) == 11 and (r[50].distance is None) != (r[0].distance is None)


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, [1.0] * 64)]) == []
