"""Model loops: ranges, determinism and rules; no accuracy is claimed on random labels."""

import random

import pytest
from pyspark.sql import functions as F

from carnet.operators import evaluate as E
from carnet.operators import factors as R
from carnet.operators import features as Y
from carnet.operators import models as M
from carnet.operators import stats as Z


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(42)
    rows = []
    for i in range(260):
        x, noise = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, x, noise, float(rng.randint(0, 1)), float(x + 0.3 * noise > 0.2), float(rng.randint(0, 1))))
    df = spark.createDataFrame(rows, "id int, x double, noise double, flag double, label double, other double")
    return df.withColumn("split", Y.hash_split(F.col("id"), 0.75)).persist()


def parts(df, columns):
    rows = M.assemble(df, columns)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@pytest.mark.parametrize("kind,params", [("tree", {"maxDepth": 3}), ("forest", {"numTrees": 5}), ("linear_svc", {"maxIter": 10}), ("logreg", {}), ("gbt", {"maxIter": 5})])
def test_classifiers_learn_a_clear_rule(cohort, kind, params):
    train, test = parts(cohort, ["x", "noise"])
    predicted = M.fit_predict(train, test, kind, ["id"], **params)
    scores = E.with_scores(E.confusion(predicted)).first()
    assert scores["sensitivity"] >= 0.6 and scores["specificity"] >= 0.8
    assert predicted.where(~F.col("confidence").between(0, 1)).count() == 0


def test_random_labels_only_run(cohort):
    train, test = parts(cohort, ["x", "noise", "flag"])
    predicted = M.fit_predict(train, test, "gbt", ["id"], label="other", maxIter=3)
    assert predicted.count() == test.count()


def test_multi_output_stacks_features(cohort):
    train, test = parts(cohort, ["x", "noise"])
    stacked = M.multi_output(train, test, "tree", ["id"], ["label", "other"], maxDepth=2)
    assert {r["feature"]: r["count"] for r in stacked.groupBy("feature").count().collect()} == {"label": test.count(), "other": test.count()}


def test_folds_cover_every_row_once(cohort):
    rows = M.assemble(cohort, ["x", "noise"])
    predicted = M.out_of_fold(rows, "tree", ["id"], ["label"], "id", folds=3, maxDepth=3)
    assert predicted.count() == 260 and predicted.select("id").distinct().count() == 260


def test_grid_search_orders_by_score(cohort):
    rows = M.assemble(cohort, ["x", "noise"])
    found = M.grid_search(rows, "tree", {"maxDepth": [1, 3]}, folds=2).collect()
    assert len(found) == 2 and found[0]["score"] >= found[1]["score"] and 0 <= found[1]["score"] <= 1


def test_univariate_models_pass_limits(cohort):
    rows = {r["feature"]: r["kept"] for r in M.univariate_models(cohort, ["x", "flag"], "tree", "id", folds=2, maxDepth=2).collect()}
    assert rows == {"x": True, "flag": False}


def test_stepwise_respects_limits_and_pairs(cohort):
    train, test = cohort.where("split = 'train'"), cohort.where("split = 'test'")
    steps = M.stepwise(train, test, ["x"], ["x", "noise", "flag"], "tree", 40, 40, pairs=[("x", "flag")], maxDepth=3).collect()
    assert [r["tried"] for r in steps] == ["start", "noise"]
    with pytest.raises(ValueError):
        M.stepwise(train, test, ["flag"], ["x"], "tree", 0, 0, maxDepth=2)


def test_importances_rank_the_signal(cohort, spark):
    rows = M.assemble(cohort, ["x", "flag"])
    table = M.importances(M.classifier("forest", numTrees=5).fit(rows), ["x", "flag"], spark).collect()
    assert table[0]["feature"] == "x"


def test_subset_scores(cohort):
    rows = M.subset_scores(cohort.where("split = 'train'"), cohort.where("split = 'test'"), {"all": ["x", "flag"], "flag": ["flag"]}, "tree", maxDepth=3).collect()
    assert {r["subset"] for r in rows} == {"all", "flag"}


def test_pca_shares_and_circle(cohort):
    rows = M.assemble(cohort, ["x", "noise", "flag"])
    coords, components, inertia = R.principal_components(rows, "id", ["x", "noise", "flag"], 3)
    shares = [r["share"] for r in inertia.orderBy("axis").collect()]
    assert coords.count() == 260 and abs(sum(shares) - 1) < 1e-6 and shares == sorted(shares, reverse=True)
    assert R.correlation_circle(components, 1, 2, top=2).count() == 2


def test_mca_and_famd(cohort):
    df = cohort.withColumn("cat", F.when(F.col("x") > 0, "a").otherwise("b")).withColumn("cat2", F.col("flag").cast("int").cast("string"))
    _, components, inertia = R.multiple_correspondence(df, "id", ["cat", "cat2"], 2)
    assert {r["feature"] for r in components.select("feature").distinct().collect()} == {"cat=a", "cat=b", "cat2=0", "cat2=1"}
    assert inertia.where("share < -1e-9").count() == 0
    _, components, _ = R.mixed_data(df, "id", ["x", "noise"], ["cat"], 3)
    assert R.contributions(components).groupBy("axis").agg(F.sum("contribution").alias("c")).where("abs(c - 1) > 1e-6").count() == 0


def test_imputation_strategies(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (9.0, "b"), (None, None)], "x double, c string")
    last = lambda d, c: [r[c] for r in d.collect()][-1]
    assert last(Z.impute(df, ["x"], "mean"), "x") == 4.0
    assert last(Z.impute(df, ["x"], "median"), "x") == 2.0
    assert last(Z.impute(df, ["c"], "most_frequent"), "c") == "b"


def test_pairs_keep_the_first(spark):
    assert Z.at_most_one_of_pair(["g", "p", "age", "echo.oma", "irm.oma"], [("g", "p"), ("echo.oma", "irm.oma")]) == ["g", "age", "echo.oma"]


def test_text_vectors_have_length_one(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c", "c"])], "id int, tokens array<string>")
    out = M.text_pipeline(10).fit(df).transform(df)
    assert [len(r["features"]) for r in out.collect()] == [3, 3]


def test_univariate_models_deal_the_folds_once(cohort, monkeypatch):
    """Folds do not depend on the feature, so rows are ranked and stored once for all of them."""
    dealt, plain = [], M.fold_by_labels
    monkeypatch.setattr(M, "fold_by_labels", lambda *args: dealt.append(args) or plain(*args))
    M.univariate_models(cohort, ["x", "flag", "noise"], "tree", "id", folds=2, maxDepth=2)
    assert len(dealt) == 1
