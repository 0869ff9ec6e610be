"""Clusters against plain integers, bounds against all distances, odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carnet.llm import centroids


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain(rows, settings):
    """Rows (vec_id, cluster, distance) and centroids by comparing everything."""
    kept = [(i, [math.floor(settings.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == settings.dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"{settings.seed}:{i}".encode()).hexdigest())
    centres = [list(v) for _, v in sorted(kept, key=lambda r: (mark(r[0]) if r[0] is not None else (True, ""), r[1]))[:settings.k]]
    for n in range(settings.rounds + 1):
        best = [min((square(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if n < settings.rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, b) in zip(kept, best) if b == j]
                if mine:
                    centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted([(i, j, d) for (i, _), (d, j) in zip(kept, best)], key=str), centres


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def answer(found):
    return sorted(map(tuple, found.rows.select("vec_id", "cluster", "distance").collect()), key=str)


def points(n, dims, rng, spread=0.05):
    """Blobs with repeated rows and ties on a coarse grid."""
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    out = []
    for i in range(n):
        m = rng.choice(middles)
        out.append((i, [round((x + rng.gauss(0, spread)) * 32) / 32 for x in m]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_comparing_everything(spark, seed):
    rng = random.Random(seed)
    settings = centroids.Settings(k=7, rounds=6, dims=3, scale=16.0)
    rows = points(400, 3, rng)
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [rows[6], rows[6], (None, rows[7][1]), (None, None)]
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, None, 2.0]), (2002, [float("nan"), 0.0, 0.0]), (2003, [float("inf"), 0.0, 0.0]), (2004, []), (2005, [0.0, 0.0, 0.0]), (2006, [-0.01, 0.0, 900.0])]
    df = vectors(spark, rows).withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1)).repartition(3)
    found = centroids.cluster(df, settings)
    want, centres = plain(rows, settings)
    assert answer(found) == want
    assert found.centres.tolist() == centres


def test_bounds_spare_distances_and_stay_exact():
    """Over many rounds of moving centroids the assignment is the nearest one, with far fewer distances than all."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-2000, 2000, (12, 8))
    data = (middles[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    history = [data[:12].copy()]
    own, bounds, rounds = centroids.Step(np.stack(history)).start(data)
    evaluated = []
    for n in range(1, 40):
        if n < 15:
            history.append(np.array([data[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else history[-1][j] for j in range(12)]))
        else:  # there and back: summed drifts would grow, the displacement does not
            history.append(history[14] + (40 if n % 2 else 0))
        own, spent = centroids.Step(np.stack(history)).renew(data, own, bounds, rounds)
        exact = ((data[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (own == exact.argmin(axis=1)).all()
        evaluated.append(spent)
    assert sum(evaluated) < 0.25 * 39 * 3000 * 12
    assert evaluated[-1] < 0.3 * 3000 * 12


def test_ties_go_to_the_smaller_number():
    history = np.array([[[0, 0], [4, 0], [0, 0]]])
    own, bounds, rounds = centroids.Step(history).start(np.array([[2, 0], [0, 0], [4, 0]]))
    assert own.tolist() == [0, 0, 1]
    moved = np.concatenate([history, [[[8, 0], [4, 0], [0, 0]]]])
    own, _ = centroids.Step(moved).renew(np.array([[2, 0], [0, 0], [6, 0]]), np.array([0, 0, 1]), bounds, rounds)
    assert own.tolist()[:2] == [1, 2]


def test_few_and_no_vectors(spark):
    settings = centroids.Settings(k=5, rounds=2, dims=2, scale=1.0)
    few = [(1, [0.0, 0.0]), (2, [9.0, 0.0]), (3, [9.0, 0.0])]
    found = centroids.cluster(vectors(spark, few), settings)
    assert answer(found) == plain(few, settings)[0] and len(found.centres) == 3
    for rows in ([], [(1, None)], [(1, [1.0])]):
        none = centroids.cluster(vectors(spark, rows), settings)
        assert centroids.described(none).collect() == [] and centroids.described(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components_are_saturated(spark):
    settings = centroids.Settings(k=2, rounds=2, dims=2, scale=256.0)
    rows = centroids.described(centroids.cluster(vectors(spark, [(1, [3e38, -3e38]), (2, [1.0, 1.0]), (3, [3e38, -3e38])]), settings)).collect()
    by = {r["vec_id"]: r for r in rows}
    assert by[1]["cluster"] == by[3]["cluster"] and by[1]["distance"] == by[3]["distance"]
    assert all(r["distance"] >= 0 for r in rows)
