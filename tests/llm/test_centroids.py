import hashlib
import math
import random

import numpy as np
import pytest
from oracle import difference

from raritas.llm import centroids
from raritas.llm.centroids import Centroids, States, cluster_vectors, search, squared


def brute(rows, clusters, rounds, dimension, scale=4, salt=3):
    """(key, cluster, distance) of each kept row, and the centroids, by plain loops."""
    kept = [
        (k, tuple(math.floor(scale * float(x)) for x in v))
        for k, v in rows
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    ]
    hashed = sorted((hashlib.sha256(f"{salt}:{'' if k is None else k}".encode()).hexdigest(), v) for k, v in kept)
    points = [v for _, v in hashed[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        members = [nearest(v)[1] for _, v in kept]
        for c in range(len(points)):
            own = [v for (_, v), m in zip(kept, members) if m == c]
            if own:
                points[c] = tuple(sum(x) // len(own) for x in zip(*own))
    return sorted([(k, c, d) for k, v in kept for d, c in [nearest(v)]], key=repr), points


def test_odd_rows_and_clashing_columns(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-1.5, -0.5, 0.0, 0.25, 2.0]) for _ in range(3)]) for i in range(400)]
    rows += [(7, rows[7][1])] * 30 + [(None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0]), (500, None), (501, [1.0, None, 0.0])]
    rows += [(502, [1.0, float("nan"), 0.0]), (503, [1.0, float("inf"), 0.0]), (504, [1.0, 2.0]), (505, [])]
    given = [(k, v, 0, b"x", 1, "c") for k, v in rows]
    table = spark.createDataFrame(given, "vec_id long, embedding array<float>, key int, v binary, first int, centroid string").repartition(7)
    out, points = cluster_vectors(table, "vec_id", "embedding", 5, 4, 3, scale=4)
    wanted, ends = brute(rows, 5, 4, 3)
    assert sorted(map(tuple, out.collect()), key=repr) == wanted
    assert [tuple(p) for p in points.tolist()] == ends


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, rows):
    given = [(i, [float(i), 1.0]) for i in range(rows)]
    out, points = cluster_vectors(spark.createDataFrame(given, "k long, x array<double>"), "k", "x", 8, 3, 2, scale=4)
    wanted, ends = brute(given, 8, 3, 2)
    assert sorted(map(tuple, out.collect()), key=repr) == wanted and len(points) == len(ends) == rows


def test_too_large_components_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0])], "k long, x array<double>")
    with pytest.raises(Exception, match="exceeds"):
        cluster_vectors(table, "k", "x", 2, 1, 2)[0].collect()


@pytest.mark.parametrize("spread", [2, 40, 4000])
def test_search_keeps_exact_centroids_and_true_bounds(spread):
    rng = np.random.default_rng(spread)
    middles = rng.integers(-spread, spread + 1, (9, 6)) * 3
    points = (middles[rng.integers(0, 9, 3000)] + rng.integers(-spread, spread + 1, (3000, 6))).astype(np.int64)
    at, before, states, taken = points[:20].copy(), None, States.unknown(len(points), 20), 0
    for _ in range(12):
        taken += search(points, states, Centroids.of(at, before))
        every = squared(points[:, None, :], at[None, :, :])
        nearest = np.argmin(every, axis=1)  # the first of equals
        assert np.array_equal(states.first, nearest)
        own = np.sqrt(every[np.arange(len(points)), nearest])
        every[np.arange(len(points)), nearest] = np.iinfo(np.int64).max
        assert np.all(states.upper * (1 + 1e-9) >= own) and np.all(states.lower * (1 - 1e-9) <= np.sqrt(every.min(axis=1)))
        before = at
        at = np.array([points[nearest == c].sum(axis=0) // max(1, (nearest == c).sum()) if np.any(nearest == c) else at[c] for c in range(20)])
    if spread > 2:
        assert taken < 0.6 * 12 * len(points) * 20


def test_query_matches_sql(spark):
    assert difference(spark, centroids.query, centroids.SQL, "/root/testdata/sf0.001") is None
