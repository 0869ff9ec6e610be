"""Classifier evaluation on long prediction tables (id, feature, y_true, y_pred, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet.operators.ranking import with_running_sums


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def counts(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    t, p = F.col(y_true), F.col(y_pred)
    return [_count((t == 1) & (p == 1)).alias("tp"), _count((t == 0) & (p == 1)).alias("fp"), _count((t == 0) & (p == 0)).alias("tn"), _count((t == 1) & (p == 0)).alias("fn")]


def confusion(df: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(*counts())


def confusion_percent(df: DataFrame) -> DataFrame:
    """Share of each prediction among the rows of a true class, in percent."""
    cells = df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(W.partitionBy("y_true"))
    return cells.withColumn("percent", F.round(100.0 * F.col("n") / whole, 6))


def outcome_kind(y_true: Column, y_pred: Column) -> Column:
    return F.when(y_pred > y_true, "FP").when(y_pred < y_true, "FN").when(y_true == 1, "TP").when(y_true == 0, "TN")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def with_scores(confused: DataFrame, places: int = 6) -> DataFrame:
    """Sensitivity, specificity and their mean, precision, accuracy, F1, and the composite metric: sensitivity when
    specificity reaches 0.8, else the mean of both."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    mean = (sens + spec) / 2
    named = {"sensitivity": sens, "specificity": spec, "balanced": mean, "precision": ratio(tp, tp + fp), "accuracy": ratio(tp + tn, tp + tn + fp + fn),
             "f1": ratio(2 * tp, 2 * tp + fp + fn), "composite": F.when(spec >= 0.8, sens).otherwise(mean)}
    return confused.withColumns({name: F.round(value, places) for name, value in named.items()})


FIRST_STEP, LAST_STEP = 5, 99


def threshold_step(score: Column) -> Column:
    """Number of hundredths strictly below the score, corrected for rounding of the product."""
    base = F.floor(score * 100)
    return F.when((base + 1) / 100 < score, base + 1).when(base / 100 < score, base).otherwise(base - 1)


def threshold_sweep(df: DataFrame, score: str, y_true: str) -> DataFrame:
    """Sensitivity and specificity for thresholds 0.05 to 0.99 by 0.01, a prediction being positive above the threshold.
    Rows are counted once by the highest threshold they exceed; the sweep is a running sum over those 96 counts."""
    step = F.least(F.lit(LAST_STEP), F.greatest(F.lit(FIRST_STEP - 1), threshold_step(F.col(score)))).cast("int")
    counted = df.groupBy(step.alias("step")).agg(_count(F.col(y_true) == 1).alias("p"), _count(F.col(y_true) == 0).alias("n"))
    steps = df.sparkSession.range(FIRST_STEP - 1, LAST_STEP + 1).select(F.col("id").cast("int").alias("step"))
    full = steps.join(counted, "step", "left").fillna(0)
    above = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summed = full.select("step", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("neg"))
    return summed.where(F.col("step") >= FIRST_STEP).select(
        (F.col("step") / 100).alias("threshold"), F.round(ratio(F.col("tp"), F.col("pos")), 6).alias("sensitivity"),
        F.round(ratio(F.col("neg") - F.col("fp"), F.col("neg")), 6).alias("specificity"))


def best_threshold(sweep: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Highest sensitivity, then highest specificity, among thresholds that are specific enough; the lowest one on ties."""
    best = F.max(F.struct("sensitivity", "specificity", (-F.col("threshold")).alias("k"))).alias("b")
    row = sweep.where(F.col("specificity") >= at_least).agg(best)
    return row.select((-F.col("b.k")).alias("threshold"), "b.sensitivity", "b.specificity")


def curve_points(df: DataFrame, score: str, y_true: str) -> DataFrame:
    """ROC and precision-recall points at every distinct score, highest first. Equal scores are merged before the
    running sums, which are kept exact across range partitions."""
    merged = df.groupBy(F.col(score).alias("score")).agg(_count(F.col(y_true) == 1).alias("p"), _count(F.col(y_true) == 0).alias("n"))
    run = with_running_sums(merged, [F.desc("score")], {"tp": "p", "fp": "n"})
    total = df.agg(F.struct(_count(F.col(y_true) == 1).alias("p"), _count(F.col(y_true) == 0).alias("n")).alias("t")).scalar()
    return run.select("score", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / total["p"], 6).alias("tpr"),
                      F.round(F.col("fp") / total["n"], 6).alias("fpr"))


def feature_report(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of classes 1 and 0 per feature, best F1 of class 1 first."""
    c = confusion(df, ("feature",))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        "feature", F.round(ratio(tp, tp + fp), 6).alias("precision_1"), F.round(ratio(tp, tp + fn), 6).alias("recall_1"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1_1"),
        F.round(ratio(tn, tn + fn), 6).alias("precision_0"), F.round(ratio(tn, tn + fp), 6).alias("recall_0"), F.round(ratio(2 * tn, 2 * tn + fp + fn), 6).alias("f1_0"),
    ).orderBy(F.desc("f1_1"), "feature")


def stack_predictions(tables: dict[str, DataFrame]) -> DataFrame:
    """One long table from one prediction table per feature."""
    parts = [df.withColumn("feature", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def argmax(scores: Column) -> Column:
    """Position of the largest score, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def precision_recall_table(report: DataFrame, of_interest: list[str]) -> DataFrame:
    both = report.where(F.col("precision_1").isNotNull() & F.col("recall_1").isNotNull())
    return both.select("feature", "precision_1", "recall_1", F.col("feature").isin(*of_interest).alias("of_interest"))


def multilabel_summary(df: DataFrame, patient: str) -> DataFrame:
    """Micro and macro scores of class 1, mean accuracy per patient and share of patients with every feature right."""
    per_feature = confusion(df, ("feature",))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = per_feature.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("p"), ratio(tp, tp + fn).alias("r"), ratio(2 * tp, 2 * tp + fp + fn).alias("f"))
    macro = scored.agg(
        F.round(F.avg("p"), 2).alias("precision_macro"), F.round(F.avg("r"), 2).alias("recall_macro"), F.round(F.avg("f"), 2).alias("f1_macro"),
        F.round(F.sum("tp") / (F.sum("tp") + F.sum("fp")), 2).alias("precision_micro"), F.round(F.sum("tp") / (F.sum("tp") + F.sum("fn")), 2).alias("recall_micro"))
    p, r = F.col("precision_micro"), F.col("recall_micro")
    macro = macro.withColumn("f1_micro", F.round(2 * p * r / (p + r), 2))
    right = (F.col("y_true") == F.col("y_pred")).cast("int")
    patients = df.groupBy(patient).agg(F.avg(right).alias("a"), F.min(right).alias("all_right"))
    means = patients.agg(F.struct(F.round(F.avg("a"), 2).alias("a"), F.round(F.avg("all_right"), 6).alias("e")).alias("m")).scalar()
    return macro.withColumn("accuracy_avg", means["a"]).withColumn("exact_match_ratio", means["e"])


def best_and_worst(report: DataFrame, score: str, n: int) -> DataFrame:
    """Top and bottom features by a score, zero scores left out; each side is a bounded top-k."""
    scored = report.where(F.col(score) > 0).select("feature", F.col(score).alias("score"))
    best = scored.orderBy(F.desc("score"), "feature").limit(n).withColumn("side", F.lit("best"))
    worst = scored.orderBy("score", "feature").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def patient_majority(df: DataFrame, patient: str) -> DataFrame:
    """Class of each patient by vote of its notes; ties go to the most common true class overall."""
    votes = df.groupBy(patient, "y_pred").agg(F.count("*").alias("n"))
    tops = votes.groupBy(patient).agg(F.max(F.struct("n", "y_pred")).alias("top"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    truth = df.groupBy("y_true").agg(F.count("*").alias("n"))
    common = truth.agg(F.max(F.struct("n", (-F.col("y_true")).alias("k"))).alias("c")).select((-F.col("c.k")).alias("v")).scalar()
    tied = (F.size("ns") > 1) & (F.get("ns", F.lit(0)) == F.get("ns", F.lit(1)))
    return tops.select(patient, F.when(tied, common).otherwise(F.col("top.y_pred")).cast("int").alias("y_pred"), tied.alias("tied"))
