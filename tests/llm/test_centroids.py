"""Clusters against a plain version that holds every vector."""

import hashlib
import math
import random

import numpy as np
import pytest

from matchloom.llm.centroids import centroid_digest, cluster, nearest

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, centroids, rounds, size):
    kept = [(v, [math.floor(64 * float(np.float32(x))) for x in e]) for v, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) and -(2**21) <= x < 2**21 for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    now = [q for _, q in sorted(kept, key=key)[:centroids]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(now)), key=lambda k: (far(q, now[k]), k))
    for _ in range(rounds):
        at = [near(q) for _, q in kept]
        new = []
        for k, c in enumerate(now):
            own = [q for (_, q), a in zip(kept, at) if a == k]
            new.append([sum(x) // len(own) for x in zip(*own)] if own else c)
        now = new
    rows = [(v, near(q), far(q, now[near(q)])) for v, q in kept]
    of = lambda k: sum(d for _, c, d in rows if c == k)
    return sorted([(v, c, d, of(c), sum(x[2] for x in rows), now[c]) for v, c, d in rows], key=repr)


def vectors(seed, size, n=150):
    rng = random.Random(seed)
    rows = [(k * 3, [rng.gauss(0, 0.3) for _ in range(size)]) for k in range(n)]
    rows += [(1000 + k, rows[5][1]) for k in range(60)] + [rows[7]] * 4 + [(None, rows[8][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, rows[0][1][:-1]), (2003, [*rows[0][1], 1.0]), (2004, [None, *rows[0][1][1:]]), (2005, [math.nan, *rows[0][1][1:]]), (2006, [math.inf, *rows[0][1][1:]]), (2007, [-math.inf, *rows[0][1][1:]])]
    return rows + [(2008, [2.0**21] * size), (2009, [-(2.0**21)] * size), (2010, [2.0**21 - 1] * size)]


@pytest.mark.parametrize(("seed", "size", "centroids", "rounds"), [(1, 64, 16, 3), (2, 3, 5, 2), (3, 2, 400, 1)])
def test_against_all_vectors(spark, seed, size, centroids, rounds):
    rows = vectors(seed, size)
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], SCHEMA + ", cluster int, q string").select("*", "q")
    got = cluster(df, centroids=centroids, rounds=rounds, size=size).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, centroids, rounds, size)


def test_empty(spark):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    for rows in ([], [(1, None)]):
        got = cluster(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == columns and got.count() == 0


def test_ties_and_far_vectors():
    at, distance = nearest(np.array([[0, 0], [2**27 - 1, -(2**27)]]), np.array([[1, 0], [0, -1], [-(2**27), 2**27 - 1]]))
    assert at.tolist() == [0, 1] and distance.tolist() == [1, (2**27 - 1) ** 2 + (2**27 - 1) ** 2]
    assert centroid_digest([1, -2]) == hashlib.sha256(b"1,-2").hexdigest()
