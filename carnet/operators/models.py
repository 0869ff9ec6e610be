"""Classifiers and model loops on Spark ML. Loops run over features, labels or parameters, never over rows."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnet.operators import evaluate as E
from carnet.operators.features import fold_by_labels
from carnet.operators.stats import at_most_one_of_pair
from carnet.session import cut_lineage

SEED = 42


def classifier(kind: str, label: str = "label", features: str = "features", **params):
    """Decision tree, random forest, linear SVM, logistic regression or gradient boosting."""
    builders = {
        "tree": lambda: DecisionTreeClassifier(labelCol=label, featuresCol=features, seed=SEED, **params),
        "forest": lambda: RandomForestClassifier(labelCol=label, featuresCol=features, seed=SEED, **params),
        "linear_svc": lambda: LinearSVC(labelCol=label, featuresCol=features, **params),
        "logreg": lambda: LogisticRegression(labelCol=label, featuresCol=features, **params),
        "gbt": lambda: GBTClassifier(labelCol=label, featuresCol=features, seed=SEED, **params),
    }
    return builders[kind]()


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df.drop("features"))


def vectors(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def text_pipeline(max_vocab: int, tokens: str = "tokens") -> Pipeline:
    """Token lists to length-1 tf-idf vectors."""
    return Pipeline(stages=[CountVectorizer(inputCol=tokens, outputCol="tf", vocabSize=max_vocab), IDF(inputCol="tf", outputCol="tfidf"),
                            Normalizer(inputCol="tfidf", outputCol="features", p=2.0)])


def predict(model, df: DataFrame, keep: list[str], label: str = "label") -> DataFrame:
    """(keep, y_true, y_pred, confidence): confidence is the probability of class 1, or the logistic of the margin."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        confidence = vector_to_array("probability")[1]
    else:
        confidence = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.select(*keep, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), confidence.alias("confidence"))


def fit_predict(train: DataFrame, test: DataFrame, kind: str, keep: list[str], label: str = "label", **params) -> DataFrame:
    return predict(classifier(kind, label, **params).fit(train), test, keep, label)


def multi_output(train: DataFrame, test: DataFrame, kind: str, keep: list[str], labels: list[str], **params) -> DataFrame:
    """One model per label column, predictions stacked by feature."""
    return E.stack_predictions({c: fit_predict(train, test, kind, keep, c, **params) for c in labels})


class CohortEvaluator(Evaluator):
    """Sensitivity, specificity or the composite metric as a Spark ML evaluator."""

    def __init__(self, metric: str = "composite", label: str = "label"):
        super().__init__()
        self.metric, self.label = metric, label

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(F.col(self.label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
        return E.with_scores(E.confusion(pairs)).first()[self.metric] or 0.0

    def isLargerBetter(self) -> bool:
        return True


def out_of_fold(df: DataFrame, kind: str, keep: list[str], labels: list[str], key: str, folds: int = 5, **params) -> DataFrame:
    """Out-of-fold predictions with folds balanced over label combinations."""
    return fold_predictions(cut_lineage(fold_by_labels(df, labels, key, folds)), kind, keep, labels, folds, **params)


def fold_predictions(folded: DataFrame, kind: str, keep: list[str], labels: list[str], folds: int, **params) -> DataFrame:
    """Predictions for each fold of a stored table from models of the others."""
    parts = [multi_output(folded.where(F.col("fold") != k), folded.where(F.col("fold") == k), kind, [*keep, "fold"], labels, **params) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def cv_scores(df: DataFrame, kind: str, key: str, label: str = "label", folds: int = 5, **params) -> DataFrame:
    """Scores of each fold."""
    predicted = out_of_fold(df, kind, [key], [label], key, folds, **params)
    return E.with_scores(E.confusion(predicted, ("fold",)))


def grid_search(df: DataFrame, kind: str, grid: dict[str, list], metric: str = "composite", label: str = "label", folds: int = 3, parallelism: int = 4) -> DataFrame:
    """Mean score of every parameter combination, best first."""
    base = classifier(kind, label)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(base.getParam(name), values)
    maps = builder.build()
    cv = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=CohortEvaluator(metric, label), numFolds=folds, parallelism=parallelism, seed=SEED)
    fitted = cv.fit(df)
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(score)) for m, score in zip(maps, fitted.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "params string, score double").orderBy(F.desc("score"), "params")


def univariate_models(df: DataFrame, columns: list[str], kind: str, key: str, label: str = "label", folds: int = 5, min_sensitivity: float = 0.5,
                      min_specificity: float = 0.8, parallelism: int = 4, **params) -> DataFrame:
    """Mean sensitivity and specificity of a model on each single feature, and whether it passes both limits. Folds do not depend on the feature: rows are
    dealt and stored once, without their key, and ``parallelism`` features are fitted at a time."""
    folded = fold_by_labels(df.select(*dict.fromkeys([*columns, label, key])), [label], key, folds)
    folded = cut_lineage(folded.select(*dict.fromkeys([*columns, label]), "fold"))

    def scored(c: str) -> tuple[str, float, float]:
        predicted = fold_predictions(assemble(folded.select(*dict.fromkeys([c, label]), "fold"), [c]), kind, [], [label], folds, **params)
        scores = E.with_scores(E.confusion(predicted, ("fold",))).agg(F.avg("sensitivity").alias("s"), F.avg("specificity").alias("p")).first()
        return c, round(scores["s"] or 0.0, 2), round(scores["p"] or 0.0, 2)

    with ThreadPool(parallelism) as pool:
        rows = pool.map(scored, columns)
    out = df.sparkSession.createDataFrame(rows, "feature string, sensitivity double, specificity double")
    return out.withColumn("kept", (F.col("sensitivity") >= min_sensitivity) & (F.col("specificity") >= min_specificity))


def _confusion_of(train, test, columns, kind, label, params) -> dict:
    predicted = fit_predict(assemble(train, columns), assemble(test, columns), kind, [], label, **params)
    return E.confusion(predicted).first().asDict()


def stepwise(train: DataFrame, test: DataFrame, start: list[str], candidates: list[str], kind: str, max_fp: int, max_fn: int, label: str = "label",
             pairs=(), **params) -> DataFrame:
    """Greedy addition: a feature stays when the model with it keeps false positives and false negatives within limits.
    The starting set must meet the limits itself; declared correlated partners never enter together."""
    base = _confusion_of(train, test, start, kind, label, params)
    if base["fp"] > max_fp or base["fn"] > max_fn:
        raise ValueError(f"the starting set gives fp={base['fp']}, fn={base['fn']}")
    best, rows = list(start), [(0, "start", ", ".join(start), base["fp"], base["fn"], True)]
    for i, c in enumerate([c for c in candidates if c not in start], 1):
        if at_most_one_of_pair([*best, c], pairs)[-1] != c:
            continue
        got = _confusion_of(train, test, [*best, c], kind, label, params)
        keep = got["fp"] <= max_fp and got["fn"] < max_fn
        best = [*best, c] if keep else best
        rows.append((i, c, ", ".join(best), got["fp"], got["fn"], keep))
    return train.sparkSession.createDataFrame(rows, "step int, tried string, kept_set string, fp long, fn long, kept boolean")


def importances(model, columns: list[str], spark) -> DataFrame:
    values = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame(list(zip(columns, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def subset_scores(train: DataFrame, test: DataFrame, subsets: dict[str, list[str]], kind: str, label: str = "label", **params) -> DataFrame:
    """Best threshold, sensitivity and specificity of a model on each named feature subset."""
    out = None
    for name, columns in subsets.items():
        predicted = fit_predict(assemble(train, columns), assemble(test, columns), kind, [], label, **params)
        best = E.best_threshold(E.threshold_sweep(predicted, "confidence", "y_true"), 0.0).select(F.lit(name).alias("subset"), F.lit(len(columns)).alias("n_features"), "*")
        out = best if out is None else out.unionByName(best)
    return out
