"""Segments against brute force, odd inputs, and accuracy on the held-out fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carnet.llm import toxicity
from carnet.llm.common import fold


def plain_segments(scores):
    """Maximal-scoring segments by definition: best segment, then left and right of it."""
    out = []

    def go(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-12 or (abs(total - best[0]) <= 1e-12 and j - i < best[2] - best[1])):
                    best = (total, i, j)
        if best:
            go(lo, best[1])
            out.append((best[1], best[2], best[0]))
            go(best[2] + 1, hi)

    go(0, len(scores))
    return out


def test_segments():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice((-3.1, -1.7, -0.53, 0.41, 1.37, 2.9)) for _ in range(rng.randint(0, 24))]
        got = toxicity.segments(np.array(scores))
        assert [g[:2] for g in got] == [p[:2] for p in plain_segments(scores)]
        assert np.allclose([g[2] for g in got], [p[2] for p in plain_segments(scores)])


def test_many_segments_take_linear_time():
    scores = np.tile([1.0, -1.0, 2.0, -2.5], 200_000)
    assert len(toxicity.segments(scores)) > 0


def test_held_out_accuracy(spark):
    """At sf0.01 labels are few; still nearly all toxic documents of the held-out fold are found, and next to no clean one."""
    from carnet.llm import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    scored = QUERIES["op2_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out")
    rows = scored.select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, ("you idiot clown " if i % 2 else "fine day ") + f"word{i % 7} and more text") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "idiot " * 50_000), (None, "fine day"), (3, rows[3][1]), (103, "... 123 $$$")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(0)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (3, 0), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("z"))
    return docs, labels


def test_odd_rows(spark, odd):
    docs, labels = odd
    model = toxicity.fit(docs, labels, F.lit(True))
    rows = toxicity.score(docs, model, "t").select("doc_id", "text", "t.*").collect()
    assert len(rows) == 66 and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["score"] > 0.5 > by[2]["score"] and by[102]["score"] > 0.5
    assert by[100]["score"] == by[101]["score"] == by[103]["score"] and by[100]["passages"] == []
    first = by[1]["passages"][0]
    assert "idiot clown" in " ".join(by[1]["text"].split()[first["first"]:first["last"] + 1])


def test_without_labels_or_documents(spark, odd):
    docs, labels = odd
    none = toxicity.fit(docs, labels.where(F.lit(False)), F.lit(True))
    assert all(r[0] < 1e-9 for r in toxicity.score(docs, none, "t").select("t.score").collect())
    one = toxicity.fit(docs, labels.where("toxic = 1"), F.lit(True))
    assert all(r[0] > 1 - 1e-9 for r in toxicity.score(docs, one, "t").select("t.score").collect())
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels, fold(F.col("doc_id"), 4) != 2), "t").count() == 0
