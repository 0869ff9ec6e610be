"""Folds over several labels: the plan on counts against dealing row by row, shares of every label, rare combinations, repeatability."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carnet.operators import features as Y


def plain_plan(rows, folds):
    """Iterative stratification row by row."""
    rows = list(rows)
    counts = Counter(at for r in rows for at in enumerate(r))
    wanted = {at: [n / folds] * folds for at, n in counts.items()}
    room, out = [len(rows) / folds] * folds, {r: [0] * folds for r in rows}
    left = Counter(rows)
    while left:
        open_ = Counter()
        for r, n in left.items():
            for at in enumerate(r):
                open_[at] += n
        value = min(open_, key=lambda v: (open_[v], v[0], v[1] is not None, str(v[1])))
        for combo in sorted((c for c in left if c[value[0]] == value[1]), key=lambda c: [(x is not None, str(x)) for x in c]):
            for _ in range(left.pop(combo)):
                j = max(range(folds), key=lambda j: (wanted[value][j], room[j], -j))
                out[combo][j] += 1
                room[j] -= 1
                for at in enumerate(combo):
                    wanted[at][j] -= 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_dealing_rows(seed):
    rng = random.Random(seed)
    folds, labels = rng.randint(2, 7), rng.randint(1, 4)
    rows = [tuple(rng.choices(["0", "1", None, "é"], [60, 25, 3, 1])[0] for _ in range(labels)) for _ in range(rng.randint(1, 700))]
    plan = Y.stratified_plan(dict(Counter(rows)), folds)
    assert plan == plain_plan(rows, folds)
    # Every value's rows in a fold are within a few of its quota; those of the rarest are within one.
    counts = Counter(at for r in rows for at in enumerate(r))
    rarest = min(counts, key=lambda v: (counts[v], v[0], v[1] is not None, str(v[1])))
    for (at, value), n in counts.items():
        shares = [sum(p[j] for c, p in plan.items() if c[at] == value) for j in range(folds)]
        assert sum(shares) == n and max(abs(s - n / folds) for s in shares) < (1 if (at, value) == rarest else 3)


def test_large_counts_are_dealt_in_bulk():
    plan = Y.stratified_plan({("0", "0"): 3_000_000_000, ("0", "1"): 1_000_003, ("1", "0"): 7, ("1", "1"): 2}, 5)
    assert [sum(p) for p in plan.values()] == [3_000_000_000, 1_000_003, 7, 2]
    for at, value, n in ((0, "1", 9), (1, "1", 1_000_005)):
        shares = [sum(p[j] for c, p in plan.items() if c[at] == value) for j in range(5)]
        assert max(abs(s - n / 5) for s in shares) < 1.01


def test_folds_of_a_table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.choice(["x", None]), 1) for i in range(500)] + [(1000, "rare", "x", 1), (1001, "rare", None, 1), (1002, "a|", "x", 1), (1003, "a", "|x", 1)]
    df = spark.createDataFrame(rows, "id int, one string, two string, fold int").drop("fold").withColumn("rank", F.lit(0)).drop("rank")
    got = {r["id"]: r for r in Y.fold_iteratively(df, ["one", "two"], "id", 5).collect()}
    plan = Y.stratified_plan(dict(Counter((r[1], r[2]) for r in rows)), 5)
    assert Counter((r["one"], r["two"], r["fold"]) for r in got.values()) == Counter({(*c, j): n for c, p in plan.items() for j, n in enumerate(p) if n})
    again = {r["id"]: r["fold"] for r in Y.fold_iteratively(df.repartition(7), ["one", "two"], "id", 5).collect()}
    assert again == {i: r["fold"] for i, r in got.items()}
    assert got[1000]["fold"] != got[1001]["fold"]
    assert Y.fold_iteratively(df.limit(0), ["one", "two"], "id").collect() == []


def test_rare_combinations_do_not_share_a_fold(spark):
    """One row of each of 40 combinations: eight to each of five folds."""
    df = spark.range(40).select("id", F.concat(F.lit("l"), F.col("id")).alias("a"), F.lit(1).alias("b"))
    assert Counter(r["fold"] for r in Y.fold_by_labels(df, ["a", "b"], "id", 5).collect()) == Counter({j: 8 for j in range(5)})
