"""Token ids in the row: against plain Python, in slices, padded to the longest note and by batch."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carnet.operators import vocab as V


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 9, 40]))]) for i in range(300)] + [(1000, None), (1001, ["unseen", "a1"] * 700)]
    return dict(rows), spark.createDataFrame(rows, "id int, tokens array<string>").withColumn("ids", F.lit("x")).withColumn("token", F.lit(1))


def index(spark):
    return spark.createDataFrame([(f"{c}{n}", 2 + 31 * i + n) for i, c in enumerate("abcdefgh") for n in range(31)], "token string, token_id int")


@pytest.mark.parametrize("rows", [1000, 30])
def test_ids_equal_plain_lookup(spark, notes, rows):
    plain, df = notes
    known = {r["token"]: r["token_id"] for r in index(spark).collect()}
    got = {r["id"]: list(r["ids"]) for r in V.index_tokens(df, ["id"], F.col("tokens"), index(spark), rows=rows).collect()}
    assert got == {i: [known.get(t, 1) for t in ts or []] for i, ts in plain.items()}


def test_no_token_is_shuffled(spark, notes):
    plan = V.index_tokens(notes[1], ["id"], F.col("tokens"), index(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_empty_index_and_full_view(spark, notes):
    plain, df = notes
    got = {r["id"]: list(r["ids"]) for r in V.index_and_pad(df.where("id < 300"), ["id"], F.col("tokens"), index(spark).limit(0)).collect()}
    assert got == {i: [0] * (40 - len(ts)) + [1] * len(ts) for i, ts in plain.items() if i < 300}
    assert V.index_and_pad(df.limit(0), ["id"], F.col("tokens"), index(spark)).collect() == []


def test_batches_are_padded_to_their_own_width(spark, notes):
    plain, df = notes
    rows = V.index_tokens(df, ["id"], F.col("tokens"), index(spark))
    whole = {r["id"]: list(r["ids"]) for r in rows.collect()}
    out = V.padded_batches(rows, ["id"], batch_rows=20).collect()
    assert len(out) == len(plain)
    for r in out:
        ids = whole[r["id"]]
        assert len(r["ids"]) == r["width"] and list(r["ids"]) == [0] * (r["width"] - len(ids)) + ids and (len(ids) <= 1 or r["width"] < 2 * len(ids))
    assert max(Counter((r["width"], r["batch"]) for r in out).values()) < 45
