"""Correlations of all pairs against numpy: missing values, constants, many columns, large means."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carnet.operators import stats as Z


def plain(rows, names):
    out = {}
    for i, j in itertools.combinations(range(len(names)), 2):
        both = [(float(r[i]), float(r[j])) for r in rows if all(r[k] is not None and np.isfinite(float(r[k])) for k in (i, j))]
        x, y = np.array(both).T if both else (np.zeros(0), np.zeros(0))
        out[names[i], names[j]] = None if len(both) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0 else round(float(np.corrcoef(x, y)[0, 1]), 6)
    return out


@pytest.mark.parametrize("width", [2, 64, 65, 150])
def test_pairs_equal_numpy(spark, width):
    rng = random.Random(width)
    base = [rng.gauss(0, 1) for _ in range(90)]
    kinds = [lambda b: b + rng.gauss(0, 1), lambda b: None if rng.random() < 0.6 else b, lambda b: 7.0, lambda b: 1e9 + rng.gauss(0, 1), lambda b: rng.choice([None, float("nan"), float("inf"), b]), lambda b: -2 * b]
    rows = [[float(v) if (v := kinds[c % len(kinds)](b)) is not None else None for c in range(width)] for b in base]
    names = [f"col {c}" for c in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5).withColumn("values", F.lit(1))
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in Z.correlation_pairs(df, names).collect()}
    want = plain(rows, names)
    assert set(got) == set(want)
    for pair, value in want.items():
        assert (got[pair] is None) == (value is None) and (value is None or abs(got[pair] - value) <= 2e-6), pair


def test_no_rows_and_few_columns(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert Z.correlation_pairs(df, ["a", "b"]).collect() == []
    assert Z.correlation_pairs(df, ["a"]).collect() == [] and Z.correlation_pairs(df, []).columns == ["feature_a", "feature_b", "correlation"]


def test_one_scan_of_many_columns(spark):
    """The cohort's 1,687 columns: one scan, 1.4 million pairs."""
    width = 1_687
    df = spark.range(200).select(*[(F.sin(F.col("id") * (c % 50 + 1)) + F.lit(c)).alias(f"c{c}") for c in range(width)])
    pairs = Z.correlation_pairs(df, df.columns)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 200") == 1
    assert pairs.agg(F.count("*"), F.count_if(F.col("correlation") == 1.0)).first()[0] == width * (width - 1) // 2
