"""Axes against numpy on dense matrices, total inertia against its closed form, many categories, missing values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carnet.operators import factors as R


def dense(matrix, k):
    """Shares and directions of the centred matrix."""
    centred = matrix - matrix.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / (len(matrix) - 1))
    return values[::-1][:k] / values.sum(), vectors[:, ::-1][:, :k], centred


def loadings(components, names, k):
    out = np.zeros((len(names), k))
    for r in components.collect():
        out[names.index(r["feature"]), r["axis"] - 1] = r["loading"]
    return out


@pytest.mark.parametrize("extra", [8, 1])
def test_mca_equals_the_dense_form(spark, extra, monkeypatch):
    """With as many directions as slots one pass is exact; with few the iteration comes near, slowly here, as the variances are close to each other."""
    monkeypatch.setattr(R.axes, "__defaults__", (extra,))
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choices(["x", "y", None, "z"], [6, 3, 2, 1])[0], str(i % 4)) for i in range(300)]
    columns = ["one", "two", "three"]
    df = spark.createDataFrame(rows, "id int, one string, two string, three string").repartition(4)
    coords, components, inertia = R.multiple_correspondence(df, "id", columns, 3)
    names = sorted({f"{c}={r[i + 1]}" for r in rows for i, c in enumerate(columns) if r[i + 1] is not None})
    counts = {n: sum(f"{c}={r[i + 1]}" == n for r in rows for i, c in enumerate(columns)) for n in names}
    matrix = np.array([[any(f"{c}={r[i + 1]}" == n for i, c in enumerate(columns)) / math.sqrt(3 * counts[n] / 300) / math.sqrt(3) for n in names] for r in rows])
    shares, vectors, centred = dense(matrix, 3)
    got = loadings(components, names, 3)
    assert np.allclose([r["share"] for r in inertia.orderBy("axis").collect()], shares, atol=1e-8 if extra == 8 else 1e-4)
    assert np.allclose(np.abs(np.sum(got * vectors, axis=0))[:3 if extra == 8 else 1], 1, atol=1e-4)
    place = {r["id"]: r["axes"] for r in coords.collect()}
    assert np.allclose([place[r[0]] for r in rows], centred @ got, atol=1e-8)


def test_famd_equals_the_dense_form(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 3), rng.gauss(5, 1), rng.choice("ab"), rng.choice("xyz")) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, u double, v double, one string, two string")
    _, components, inertia = R.mixed_data(df, "id", ["u", "v"], ["one", "two"], 3)
    names = ["u", "v", "one=a", "one=b", "two=x", "two=y", "two=z"]
    numbers = np.array([r[1:3] for r in rows])
    marks = np.array([[f"one={r[3]}" == n or f"two={r[4]}" == n for n in names[2:]] for r in rows], float)
    matrix = np.hstack([(numbers - numbers.mean(axis=0)) / numbers.std(axis=0), marks / np.sqrt(marks.mean(axis=0))])
    shares, vectors, _ = dense(matrix, 3)
    assert np.allclose([r["share"] for r in inertia.orderBy("axis").collect()], shares, atol=1e-8)
    assert np.allclose(np.abs(np.sum(loadings(components, names, 3) * vectors, axis=0)), 1, atol=1e-5)


def test_ten_thousand_categories(spark):
    """A column of 10,000 categories next to one that splits the rows in two: no column per category; the first axis has the full share that two variables that
    agree can have, and the total is its closed form."""
    n, p = 20_000, 2
    df = spark.range(n).select("id", F.concat(F.lit("v"), F.col("id") % 10_000).alias("many"), (F.col("id") % 2).cast("string").alias("half"))
    levels = R.category_slots(df, ["half", "many"])
    assert levels.count() == 10_002
    _, components, inertia = R.multiple_correspondence(df, "id", ["half", "many"], 1)
    total = sum((1 / (p * p * c / n)) * (c / n) * (1 - c / n) * n / (n - 1) for c in [2] * 10_000 + [n // 2] * 2)
    # Both variables' agreement: the half is told by the many, so the first eigenvalue is 1 / p * 2 over n - 1 rows.
    assert inertia.first()["share"] * total == pytest.approx(n / (n - 1) * 2 / p / p * 1.0, rel=1e-6)
    top = {r["feature"]: r["loading"] for r in components.where("feature like 'half%'").collect()}
    assert top["half=0"] == pytest.approx(-top["half=1"], rel=1e-6)


def test_no_variance_and_few_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "id int, c string, x double")
    _, _, inertia = R.multiple_correspondence(df, "id", ["c"], 2)
    assert [r["share"] for r in inertia.collect()] == [0.0]
    assert R.multiple_correspondence(df.limit(0), "id", ["c"], 2)[2].collect() == []
