"""Exactness of the scalable joins, ranks and splits, with hot groups holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carnet import lookups
from carnet.operators import context as X
from carnet.operators import evaluate as E
from carnet.operators import features as Y
from carnet.operators import ranking as K
from carnet.operators import stats as Z
from carnet.operators import nearest
from carnet.operators import suggest as G
from carnet.operators import timeline as L


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def random_words(n, alphabet, longest, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("alphabet,longest", [("ab", 6), ("aéß", 5), ("abcdefg", 8)])
def test_edit1_pairs_equal_brute_force(spark, alphabet, longest):
    left, right = random_words(120, alphabet, longest, 1), random_words(120, alphabet, longest, 2)
    a = spark.createDataFrame([(w,) for w in left], "l string")
    b = spark.createDataFrame([(w,) for w in right], "r string")
    got = [(r["l"], r["r"]) for r in G.edit1_pairs(a, b, "l", "r").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x in left for y in right if distance(x, y) == 1}


@pytest.mark.parametrize("cutoff", [80, 60])
def test_fuzzy_pairs_equal_brute_force(spark, cutoff):
    left, right = random_words(150, "abcd", 12, 3), random_words(150, "abcd", 12, 4)
    base = random_words(60, "abcdefghij", 14, 5)
    rng = random.Random(6)
    left += [w[:i] + rng.choice("xyz") + w[i + 1:] for w in base for i in [rng.randrange(len(w))]]
    left, right = sorted(set(left)), sorted(set(right + base))
    a = spark.createDataFrame([(w,) for w in left], "word string")
    b = spark.createDataFrame([(w,) for w in right], "lex string")
    got = {(r["word"], r["lex"]) for r in G.fuzzy_pairs(a, b, cutoff=cutoff).collect()}
    score = lambda x, y: round(100.0 * (1 - distance(x, y) / max(len(x), len(y))), 2)
    assert got == {(x, y) for x in left for y in right if score(x, y) >= cutoff}
    want = {x: min((-score(x, y), y) for y in right) for x in left}
    for levels, size in (((), 1000), ((80,), 1000), ((90, 70), 40)):
        best = {r["word"]: (-r["score"], r["nearest"]) for r in nearest.nearest_words(a, b, cutoff, levels, size).collect()}
        assert best == {x: w for x, w in want.items() if -w[0] >= cutoff}


def test_metric_tree_equals_all_distances():
    """Best word and score for words of every kind, ties and words longer than a machine word included; distances of many at once."""
    rng = random.Random(12)
    lexicon = sorted({"".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 12, 63, 64, 65, 80]))) for _ in range(400)})
    held = nearest.Words(lexicon)
    vantage = rng.sample(lexicon, 20)
    to = np.array([[distance(w, v) for v in vantage] for w in lexicon])
    assert (to == np.array([nearest.Words(vantage).distances(w) for w in lexicon])).all()
    tree, spent = nearest.Tree(lexicon, vantage, to), 0
    asked = ["".join(rng.choice("abcdéz") for _ in range(rng.choice([1, 3, 6, 7, 8, 30, 64, 70]))) for _ in range(60)] + rng.sample(lexicon, 20)
    for word in asked:
        all_ = [distance(word, w) for w in lexicon]
        assert held.distances(word).tolist() == all_
        best = min((-round(100.0 * (1 - d / max(len(word), len(w))), 2), w) for d, w in zip(all_, lexicon))
        score, found, n = tree.nearest(word, 0.0, None)
        assert (-score, found) == best
        spent += n
    assert spent < len(asked) * len(lexicon)


def indel_score(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return float(round(200.0 * row[-1] / (len(a) + len(b))))


@pytest.mark.parametrize("cutoff", [80, 60])
def test_indel_pairs_equal_brute_force(spark, cutoff):
    left, right = random_words(120, "abc", 9, 7), random_words(120, "abc", 9, 8)
    a = spark.createDataFrame([(w,) for w in left], "word string")
    b = spark.createDataFrame([(w,) for w in right], "lex string")
    got = {(r["word"], r["lex"]): r["score"] for r in G.fuzzy_pairs(a, b, cutoff=cutoff, scorer="indel").collect()}
    assert got == {(x, y): indel_score(x, y) for x in left for y in right if indel_score(x, y) >= cutoff}


def hot_frame(spark, n=3000):
    """One key holds two thirds of the rows."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7 + 1).cast("int").alias("grp"), ((F.col("id") * 37) % 1000).alias("x"))


def test_global_rank_is_the_sorted_position(spark):
    df = hot_frame(spark)
    got = {r["id"]: r["rank"] for r in K.with_global_rank(df, [F.desc("x"), F.col("id")]).collect()}
    rows = sorted(((-(i * 37 % 1000), i) for i in range(3000)))
    assert got == {i: pos for pos, (_, i) in enumerate(rows, 1)}


def test_running_sums_are_exact(spark):
    df = hot_frame(spark, 1000)
    got = {r["id"]: r["s"] for r in K.with_running_sums(df, [F.col("x"), F.col("id")], {"s": "x"}).collect()}
    total, want = 0, {}
    for x, i in sorted((i * 37 % 1000, i) for i in range(1000)):
        total += x
        want[i] = total
    assert got == want


def test_hash_rank_in_a_hot_group(spark):
    ranked = K.rank_in_hash_order(hot_frame(spark), ["grp"], "id", digits=2)
    for row in ranked.groupBy("grp", "group_size").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect():
        assert row["n"] == row["group_size"] == row["d"] == row["hi"] and row["lo"] == 1


def test_splits_are_disjoint_complete_and_stable(spark):
    df = hot_frame(spark)
    first = {r["id"]: r["split"] for r in Y.three_way_split(df, "grp", "id", 0.7).collect()}
    again = {r["id"]: r["split"] for r in Y.three_way_split(df.repartition(7), "grp", "id", 0.7).collect()}
    assert len(first) == 3000 and first == again
    sizes = Y.stratified_split(df, "grp", "id", 0.75).groupBy("grp").agg(F.count("*").alias("n"), F.count(F.when(F.col("split") == "train", 1)).alias("t")).collect()
    assert all(r["t"] == int(r["n"] * 0.75) for r in sizes)


def test_resampling_balances_classes(spark, monkeypatch):
    df = spark.range(1010).select("id", (F.col("id") >= 1000).cast("int").alias("label"))
    up = {r["label"]: r["n"] for r in Y.upsample(df, "label", "id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    down = {r["label"]: r["n"] for r in Y.downsample(df, "label", "id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert up == {0: 1000, 1: 1000} and down == {0: 10, 1: 10}
    monkeypatch.setattr(Y, "COPIES_PER_TASK", 7)
    blocks = Y.upsample(df, "label", "id")
    assert blocks.count() == 2000 and blocks.select("id", "copy").distinct().count() == 2000


def test_notes_follow_their_patient(spark):
    notes = hot_frame(spark).withColumn("outcome", (F.col("x") > 990).cast("int"))
    split = Y.patient_split(notes, "grp", "outcome")
    assert split.count() == 3000
    assert split.groupBy("grp").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 1000 + [1.0, 9.0], [1e-12, 1.0, 1e12, 2.0, 2.0], [float(i * 7919 % 10007) for i in range(4001)]])
def test_exact_median(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert Z.exact_median(df, "x") == statistics.median(values)


def test_threshold_sweep_equals_direct_counts(spark):
    rng = random.Random(9)
    rows = [(rng.choice([round(rng.random(), 2), rng.random(), 0.06, 0.57, 0.58, 0.05, 1.0, 0.0]), rng.randint(0, 1)) for _ in range(500)]
    sweep = E.threshold_sweep(spark.createDataFrame(rows, "c double, y int"), "c", "y").collect()
    assert len(sweep) == 95
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    for r in sweep:
        t = r["threshold"]
        assert r["sensitivity"] == round(sum(y and c > t for c, y in rows) / pos, 6)
        assert r["specificity"] == round(sum((not y) and not c > t for c, y in rows) / neg, 6)


def test_confusion_counts_sum_to_rows(spark):
    df = spark.createDataFrame([(i % 2, (i // 2) % 2) for i in range(101)], "y_true int, y_pred int")
    row = E.confusion(df).first()
    assert sum(row) == 101
    scores = E.with_scores(E.confusion(df)).first()
    assert abs(scores["balanced"] - (scores["sensitivity"] + scores["specificity"]) / 2) < 1e-5


def test_lookup_strategies_give_the_same_rows(spark):
    facts = spark.range(1000).select((F.col("id") % 10).cast("string").alias("key"), "id")
    dim = spark.createDataFrame([(str(i), f"v{i}") for i in range(5)], "key string, value string")
    # Beyond the bounds there is no hint: Spark's own thresholds decide, so without any of those the large one is not broadcast.
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in thresholds:
            spark.conf.set(name, "-1")
        small = facts.join(lookups.as_lookup(dim), "key")
        large = facts.join(lookups.as_lookup(dim, max_rows=2), "key")
        assert sorted(small.collect()) == sorted(large.collect()) and small.count() == 500
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in thresholds:
            spark.conf.unset(name)


def test_truncation_keeps_patients_without_anchor(spark):
    notes = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 1, "2024-01-05"), (3, 1, "2024-01-09"), (4, 2, "2024-03-01")], "note int, patient int, day string").withColumn("ts", F.to_timestamp("day"))
    anchors = spark.createDataFrame([(1, "2024-01-06")], "patient int, a string").select("patient", F.to_timestamp("a").alias("anchor"))
    kept = L.truncate_timeline(notes, "patient", "ts", "note", anchors, "anchor")
    assert sorted(r["note"] for r in kept.collect()) == [1, 2, 4]
    near = L.closest_dates(notes, "patient", "ts", anchors, "anchor").first()
    early = L.closest_dates(notes, "patient", "ts", anchors, "anchor", mode="earliest").first()
    assert str(near["closest"]) == "2024-01-05" and str(early["closest"]) == "2024-01-01"


def test_kwic_fuzzy_finds_close_words(spark):
    notes = spark.createDataFrame([(1, "une douleurs vive"), (2, "rien"), (3, "Doulleur Douleur")], "id int, text string")
    keywords = spark.createDataFrame([("douleur",)], "lex string")
    got = sorted((r["id"], r["pos"], r["context"]) for r in X.kwic_fuzzy(notes, ["id"], "text", keywords, n=1).collect())
    assert got == [(1, 1, "une douleurs vive"), (3, 0, "Doulleur Douleur"), (3, 1, "Doulleur Douleur")]


def test_topic_flags(spark):
    notes = spark.createDataFrame([(1, "Nausées et vomisements"), (2, "rien")], "id int, text string")
    flags = {(r["id"], r["topic"]): r["hit"] for r in X.topic_flags(notes, ["id"], "text", {"nausées": ("nausées",), "vomissements": ("vomissements", "vomir")}).collect()}
    assert flags == {(1, "nausées"): True, (1, "vomissements"): True, (2, "nausées"): False, (2, "vomissements"): False}


def test_gazetteer_paths_agree(spark, monkeypatch):
    notes = spark.createDataFrame([(1, "kyste ovarien droit, kyste"), (2, "rien"), (3, ""), (4, "l'ovarien droit kyste ovarien")], "id int, text string")
    terms = spark.createDataFrame([("kyste", "A"), ("kyste ovarien", "B"), ("ovarien droit kyste", "C")], "term string, label string")
    run = lambda: sorted((r["id"], r["pos"], r["term"], r["label"]) for r in X.ngram_mentions(notes, ["id"], "text", terms).collect())
    small = run()
    assert small == [(1, 0, "kyste", "A"), (1, 0, "kyste ovarien", "B"), (1, 1, "ovarien droit kyste", "C"), (1, 3, "kyste", "A"), (4, 1, "ovarien droit kyste", "C"), (4, 3, "kyste", "A"), (4, 3, "kyste ovarien", "B")]
    monkeypatch.setattr(X, "small_entries", lambda stored: None)
    assert run() == small
    assert X.ngram_mentions(notes, ["id"], "text", terms.where("false")).count() == 0
