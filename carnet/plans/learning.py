"""Feature, split, model and evaluation queries."""

from pyspark.sql import functions as F

from carnet.functions import text as T
from carnet.operators import evaluate as E
from carnet.operators import factors as R
from carnet.operators import features as Y
from carnet.operators import models as M
from carnet.operators import profile as PR
from carnet.operators import records as P
from carnet.plans import cohort
from carnet.plans import inputs as I
from carnet.plans import sqlparts as S
from carnet.registry import query, spread, table
from carnet.session import cut_lineage

RANK = "row_number() OVER (PARTITION BY {g} ORDER BY md5({k}::VARCHAR), {k})"


@query("prep_text", rf"""
    WITH {I.SQL_REFERENCE}, {I.SQL_DICTIONARY},
    l AS (SELECT conv_id, turn, translate(lower(text), '{cohort.K.ASCII_PUNCTUATION.replace("'", "''")}', '{" " * len(cohort.K.ASCII_PUNCTUATION)}') AS t FROM conversations),
    c AS (SELECT conv_id, turn, string_agg(coalesce(value, w), ' ' ORDER BY p) || ' ' AS t
          FROM (SELECT conv_id, turn, u.w, u.p FROM l, unnest(regexp_split_to_array(t, '[ /,.-]')) WITH ORDINALITY AS u(w, p)) LEFT JOIN dict ON key = w GROUP BY conv_id, turn),
    a AS (SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(replace(replace(strip_accents(t), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'),
                 'ß', 'ss'), 'ø', 'o'), 'Ø', 'O'), '’', ''''), '‘', '''') AS t FROM c),
    n AS (SELECT conv_id, turn, array_to_string(list_filter(string_split(t, ' '), lambda x: NOT regexp_matches(x, '\p{{Nd}}')), ' ') AS t FROM a),
    j AS (SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS t FROM n GROUP BY 1)
    SELECT conv_id, array_to_string(list_filter(regexp_extract_all(t, '[{S.W}'']+'), lambda x: x NOT IN {S.STOPWORDS}), ' ') AS tokens FROM j""")
def prep_text(spark, d):
    notes = table(spark, d, "conversations")
    prepared = Y.prepare_notes(notes, "conv_id", "turn", "text", I.correction_dictionary(spark, d))
    return prepared.withColumn("tokens", F.array_join("tokens", " "))


@query("tfidf", f"""
    WITH t AS (SELECT conv_id, turn, unnest({S.tokens('text')}) AS term FROM conversations),
    tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM t GROUP BY ALL),
    st AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 500),
    w AS (SELECT conv_id, turn, term, tf * (ln((1 + (SELECT count(*) FROM conversations)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN st USING (term))
    SELECT conv_id, turn, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM w""")
def tfidf(spark, d):
    return Y.tf_idf(table(spark, d, "conversations"), ["conv_id", "turn"], T.norm_tokens(F.col("text")), 500)


@query("split_random", "SELECT doc_id, CASE WHEN left(md5(doc_id || ':42'), 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS split FROM documents")
def split_random(spark, d):
    return table(spark, d, "documents").select("doc_id", Y.hash_split(F.col("doc_id"), 0.8).alias("split"))


def orders_by_status(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


SQL_RANKED = f"r AS (SELECT o_orderkey, o_orderstatus, {RANK.format(g='o_orderstatus', k='o_orderkey')} AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)"


@query("split_stratified", f"WITH {SQL_RANKED} SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.75::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r")
def split_stratified(spark, d):
    return Y.stratified_split(orders_by_status(spark, d), "o_orderstatus", "o_orderkey", 0.75)


@query("split_per_class_frac", f"""WITH {SQL_RANKED}
    SELECT o_orderkey, o_orderstatus, CASE WHEN r <= round(n * 0.7::DOUBLE) THEN 'train' WHEN r <= round(n * 0.7::DOUBLE) + floor((n - round(n * 0.7::DOUBLE)) / 2) THEN 'test' ELSE 'validation' END AS split FROM r""")
def split_per_class_frac(spark, d):
    return Y.three_way_split(orders_by_status(spark, d), "o_orderstatus", "o_orderkey", 0.7)


@query("split_patient", f"""
    WITH p AS (SELECT user_id, max(CAST(value > 60 AS INT)) AS o FROM events GROUP BY user_id),
    r AS (SELECT user_id, {RANK.format(g='o', k='user_id')} AS r, count(*) OVER (PARTITION BY o) AS n FROM p)
    SELECT event_id, user_id, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM events JOIN r USING (user_id)""")
def split_patient(spark, d):
    notes = table(spark, d, "events").select("event_id", "user_id", (F.col("value") > 60).cast("int").alias("outcome"))
    return Y.patient_split(notes, "user_id", "outcome").drop("outcome")


@query("kfold_multilabel", f"""
    SELECT doc_id, quality, toxic, CAST((row_number() OVER (ORDER BY quality NULLS FIRST, toxic NULLS FIRST, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INT) AS fold FROM labels""")
def kfold_multilabel(spark, d):
    return Y.fold_by_labels(table(spark, d, "labels"), ["quality", "toxic"], "doc_id", 5)


@query("kfold_iterative")
def kfold_iterative(spark, d):
    """Folds over both labels and the language and source of the labelled document; combinations are many and some are rare."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return Y.fold_iteratively(table(spark, d, "labels").join(docs, "doc_id", "left"), ["quality", "toxic", "lang", "source"], "doc_id", 5)


SQL_TOXIC = f"r AS (SELECT doc_id, toxic, {RANK.format(g='toxic', k='doc_id')} AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels), sizes AS (SELECT max(n) AS hi, min(n) AS lo FROM r)"


@query("resample_up", f"WITH {SQL_TOXIC} SELECT doc_id, toxic, c AS copy FROM r, sizes, unnest(range(1, (hi - r) // n + 2)) AS u(c)")
def resample_up(spark, d):
    return Y.upsample(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query("resample_down", f"WITH {SQL_TOXIC} SELECT doc_id, toxic FROM r, sizes WHERE r <= lo")
def resample_down(spark, d):
    return Y.downsample(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query("upsample_patient", """
    WITH n AS (SELECT conv_id, turn, CAST((conv_id * 3 + turn) % 5 = 0 AS INT) AS outcome FROM conversations),
    s AS (SELECT count(*) FILTER (outcome = 0) - count(*) FILTER (outcome = 1) AS missing, count(DISTINCT conv_id) AS np FROM n),
    m AS (SELECT conv_id, turn, outcome, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM n WHERE outcome = 1),
    one AS (SELECT m.* FROM m, s WHERE back <= missing // np),
    l AS (SELECT conv_id, turn, outcome, row_number() OVER (ORDER BY conv_id) AS t, (SELECT missing FROM s) - (SELECT count(*) FROM one) AS todo, count(*) OVER () AS givers FROM m WHERE back = 1)
    SELECT conv_id, turn, outcome, 0::BIGINT AS copy FROM n UNION ALL SELECT conv_id, turn, outcome, 1 FROM one
    UNION ALL SELECT conv_id, turn, outcome, c FROM l, unnest(range(2, todo // givers + CAST(t <= todo % givers AS INT) + 2)) AS u(c)""")
def upsample_patient(spark, d):
    """A note counts as positive when three times its patient plus its turn is a multiple of five."""
    outcome = ((F.col("conv_id") * 3 + F.col("turn")) % 5 == 0).cast("int")
    notes = table(spark, d, "conversations").select("conv_id", "turn", outcome.alias("outcome"))
    return Y.upsample_patients(notes, "conv_id", "turn", "outcome", F.floor(F.col("turn") / 256))


@query("class_weights", """
    SELECT o_orderstatus, round((SELECT count(*)::DOUBLE / count(DISTINCT o_orderstatus) FROM orders) / count(*), 6) AS weight FROM orders GROUP BY o_orderstatus""")
def class_weights(spark, d):
    return Y.class_weights(table(spark, d, "orders"), "o_orderstatus")


# Predictions: three features per order, predicted by fixed rules, with a confidence in hundredths.
FEATURES = {
    "final": ("o_orderstatus = 'F'", "o_custkey % 3 = 0 OR o_orderstatus = 'F' AND o_orderkey % 4 = 0"),
    "urgent": ("o_orderpriority = '1-URGENT'", "o_orderpriority = '1-URGENT' AND o_custkey % 4 <> 0 OR o_orderkey % 11 = 0"),
    "large": ("o_totalprice > 300000", "o_totalprice > 250000 AND o_custkey % 9 <> 0"),
}
CONFIDENCE = "(o_orderkey * 7 + o_custkey * 13 + CASE WHEN {t} THEN 30 ELSE 0 END) % 101 / CAST(100 AS DOUBLE)"
SQL_PREDICTIONS = "pred AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS id, o_custkey AS patient, '{f}' AS feature, CAST(({t}) AS INT) AS y_true, CAST(({p}) AS INT) AS y_pred, {CONFIDENCE.format(t=t)} AS confidence FROM orders"
    for f, (t, p) in FEATURES.items()) + ")"


def predictions(spark, d):
    orders = table(spark, d, "orders")
    rows = [F.struct(F.lit(f).alias("feature"), F.expr(f"CAST(({t}) AS INT)").alias("y_true"), F.expr(f"CAST(({p}) AS INT)").alias("y_pred"),
                     F.expr(CONFIDENCE.format(t=t)).alias("confidence")) for f, (t, p) in FEATURES.items()]
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient"), F.explode(F.array(*rows)).alias("p")).select("id", "patient", "p.*")


def final_only(spark, d):
    return predictions(spark, d).where(F.col("feature") == "final")


SQL_CM = """cm AS (SELECT feature, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
    count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM pred GROUP BY feature)"""


@query("confusion", f"WITH {SQL_PREDICTIONS}, {SQL_CM} SELECT * FROM cm")
def confusion(spark, d):
    return E.confusion(predictions(spark, d), ("feature",))


@query("confusion_pct", f"""WITH {SQL_PREDICTIONS}
    SELECT y_true, y_pred, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY y_true), 6) AS percent FROM pred WHERE feature = 'final' GROUP BY y_true, y_pred""")
def confusion_pct(spark, d):
    return E.confusion_percent(final_only(spark, d))


@query("error_rows", f"""WITH {SQL_PREDICTIONS}
    SELECT id, feature, CASE WHEN y_pred > y_true THEN 'FP' ELSE 'FN' END AS kind FROM pred WHERE y_pred <> y_true""")
def error_rows(spark, d):
    kinds = predictions(spark, d).select("id", "feature", E.outcome_kind(F.col("y_true"), F.col("y_pred")).alias("kind"))
    return kinds.where(F.col("kind").isin("FP", "FN"))


@query("sens_spec", f"""WITH {SQL_PREDICTIONS}, {SQL_CM}, s AS (SELECT *, tp::DOUBLE / (tp + fn) AS se, tn::DOUBLE / (tn + fp) AS sp FROM cm)
    SELECT feature, tp, fp, tn, fn, round(se, 6) AS sensitivity, round(sp, 6) AS specificity, round((se + sp) / 2, 6) AS balanced, round(tp::DOUBLE / (tp + fp), 6) AS precision,
           round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, round(CASE WHEN sp >= 0.8 THEN se ELSE (se + sp) / 2 END, 6) AS composite FROM s""")
def sens_spec(spark, d):
    return E.with_scores(E.confusion(predictions(spark, d), ("feature",)))


SQL_SWEEP = """thr AS (SELECT i / CAST(100 AS DOUBLE) AS threshold FROM range(5, 100) AS r(i)),
    sweep AS (SELECT threshold, round(count(*) FILTER (y_true = 1 AND confidence > threshold)::DOUBLE / count(*) FILTER (y_true = 1), 6) AS sensitivity,
              round(count(*) FILTER (y_true = 0 AND NOT confidence > threshold)::DOUBLE / count(*) FILTER (y_true = 0), 6) AS specificity FROM pred, thr WHERE feature = 'final' GROUP BY threshold)"""


@query("threshold_sweep", f"WITH {SQL_PREDICTIONS}, {SQL_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, d):
    return E.threshold_sweep(final_only(spark, d), "confidence", "y_true")


@query("threshold_best", f"WITH {SQL_PREDICTIONS}, {SQL_SWEEP} SELECT * FROM sweep WHERE specificity >= 0.8 ORDER BY sensitivity DESC, specificity DESC, threshold LIMIT 1")
def threshold_best(spark, d):
    return E.best_threshold(E.threshold_sweep(final_only(spark, d), "confidence", "y_true"))


@query("pr_roc", f"""WITH {SQL_PREDICTIONS},
    s AS (SELECT round(confidence + (id % 50) / 100000.0::DOUBLE, 5) AS score, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM pred WHERE feature = 'final' GROUP BY 1),
    c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM s)
    SELECT score, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / pos, 6) AS tpr, round(fp::DOUBLE / neg, 6) AS fpr FROM c""")
def pr_roc(spark, d):
    scored = final_only(spark, d).select("y_true", F.round(F.col("confidence") + (F.col("id") % 50) / 100000.0, 5).alias("score"))
    return E.curve_points(scored, "score", "y_true")


SQL_REPORT = SQL_CM + """, rep AS (SELECT feature, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision_1, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall_1,
    round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1_1, round(tn::DOUBLE / nullif(tn + fn, 0), 6) AS precision_0, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS recall_0,
    round(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 6) AS f1_0 FROM cm)"""


@query("report_multilabel", f"WITH {SQL_PREDICTIONS}, {SQL_REPORT} SELECT * FROM rep")
def report_multilabel(spark, d):
    return E.feature_report(predictions(spark, d))


@query("report_from_predictions", f"WITH {SQL_PREDICTIONS}, {SQL_REPORT} SELECT * FROM rep")
def report_from_predictions(spark, d):
    """One prediction table per feature, stacked, then reported."""
    every = predictions(spark, d)
    return E.feature_report(E.stack_predictions({f: every.where(F.col("feature") == f).drop("feature") for f in FEATURES}))


@query("argmax_confidence", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS y_pred, list_max(embedding)::DOUBLE AS confidence FROM embeddings")
def argmax_confidence(spark, d):
    scores = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", E.argmax(scores).alias("y_pred"), F.array_max(scores).cast("double").alias("confidence"))


@query("precision_vs_recall", f"WITH {SQL_PREDICTIONS}, {SQL_REPORT} SELECT feature, precision_1, recall_1, feature IN ('urgent', 'large') AS of_interest FROM rep WHERE precision_1 IS NOT NULL AND recall_1 IS NOT NULL")
def precision_vs_recall(spark, d):
    return E.precision_recall_table(E.feature_report(predictions(spark, d)), ["urgent", "large"])


@query("eval_multilabel", f"""WITH {SQL_PREDICTIONS}, {SQL_CM},
    m AS (SELECT round(avg(tp::DOUBLE / (tp + fp)), 2) AS precision_macro, round(avg(tp::DOUBLE / (tp + fn)), 2) AS recall_macro, round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 2) AS f1_macro,
                 round(sum(tp)::DOUBLE / (sum(tp) + sum(fp)), 2) AS precision_micro, round(sum(tp)::DOUBLE / (sum(tp) + sum(fn)), 2) AS recall_micro FROM cm),
    p AS (SELECT id, avg(CAST(y_true = y_pred AS INT)) AS a, min(CAST(y_true = y_pred AS INT)) AS e FROM pred GROUP BY id)
    SELECT *, round(2 * precision_micro * recall_micro / (precision_micro + recall_micro), 2) AS f1_micro, (SELECT round(avg(a), 2) FROM p) AS accuracy_avg, (SELECT round(avg(e), 6) FROM p) AS exact_match_ratio FROM m""")
def eval_multilabel(spark, d):
    return E.multilabel_summary(predictions(spark, d), "id")


@query("best_worst", f"""WITH {SQL_PREDICTIONS}, {SQL_REPORT}
    (SELECT feature, f1_1 AS score, 'best' AS side FROM rep WHERE f1_1 > 0 ORDER BY f1_1 DESC, feature LIMIT 2)
    UNION ALL (SELECT feature, f1_1, 'worst' FROM rep WHERE f1_1 > 0 ORDER BY f1_1, feature LIMIT 2)""")
def best_worst(spark, d):
    return E.best_and_worst(E.feature_report(predictions(spark, d)), "f1_1", 2)


@query("majority_patient", f"""WITH {SQL_PREDICTIONS},
    v AS (SELECT patient, count(*) FILTER (y_pred = 1) AS n1, count(*) FILTER (y_pred = 0) AS n0 FROM pred WHERE feature = 'final' GROUP BY patient),
    o AS (SELECT y_true FROM pred WHERE feature = 'final' GROUP BY y_true ORDER BY count(*) DESC, y_true LIMIT 1)
    SELECT patient, CASE WHEN n1 = n0 THEN (SELECT y_true FROM o) WHEN n1 > n0 THEN 1 ELSE 0 END AS y_pred, n1 = n0 AS tied FROM v""")
def majority_patient(spark, d):
    return E.patient_majority(final_only(spark, d), "patient")


@query("reshape_long", " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS variable, {c}::VARCHAR AS value FROM customer" for c in ("c_name", "c_nationkey", "c_mktsegment")))
def reshape_long(spark, d):
    return P.to_long(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), ["c_custkey"], name="variable")


# Models: embeddings with a binary label, split by hash.
def vectors(spark, d):
    rows = table(spark, d, "embeddings").withColumn("digit", F.col("label")).withColumn("label", (F.col("digit") < 5).cast("double"))
    rows = rows.withColumns({"odd": (F.col("digit") % 2).cast("double"), "high": (F.col("digit") >= 8).cast("double")})
    return M.vectors(rows, "embedding").withColumn("split", Y.hash_split(F.col("vec_id"), 0.8)).drop("embedding")


def train_test(spark, d):
    rows = vectors(spark, d)
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")


def register_classifier(kind, **params):
    def run(spark, d):
        train, test = train_test(spark, d)
        return M.fit_predict(train, test, kind, ["vec_id"], **params)
    query(f"clf_{kind}")(run)


register_classifier("tree", maxDepth=5)
register_classifier("forest", numTrees=10, maxDepth=5)
register_classifier("linear_svc", maxIter=10)
register_classifier("logreg", maxIter=20)
register_classifier("gbt", maxIter=5, maxDepth=3)


@query("multi_output")
def multi_output(spark, d):
    train, test = train_test(spark, d)
    return M.multi_output(cut_lineage(train), test, "logreg", ["vec_id"], ["odd", "high"], maxIter=10)


@query("cv_scores")
def cv_scores(spark, d):
    return M.cv_scores(vectors(spark, d), "logreg", "vec_id", folds=3, maxIter=5)


@query("hyper_search")
def hyper_search(spark, d):
    return M.grid_search(vectors(spark, d), "logreg", {"regParam": [0.01, 0.1], "maxIter": [5]}, folds=2)


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, d):
    """Line items labelled by price per unit, with their hash split."""
    rows = table(spark, d, "lineitem").select(*LINE_COLUMNS, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"),
                                             (F.col("l_extendedprice") * F.col("l_discount") > 1500).cast("double").alias("label"))
    return spread(rows, "key").withColumn("split", Y.hash_split(F.col("key"), 0.8))


@query("univariate_model")
def univariate_model(spark, d):
    return M.univariate_models(lines(spark, d), LINE_COLUMNS, "tree", "key", folds=2, maxDepth=3)


@query("stepwise")
def stepwise(spark, d):
    rows = cut_lineage(lines(spark, d))
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    start = M.fit_predict(M.assemble(train, LINE_COLUMNS[:1]), M.assemble(test, LINE_COLUMNS[:1]), "tree", [], maxDepth=3)
    base = E.confusion(start).first()
    return M.stepwise(train, test, LINE_COLUMNS[:1], LINE_COLUMNS, "tree", base["fp"] + base["tn"], base["fn"] + 1, pairs=[("l_tax", "l_quantity")], maxDepth=3)


@query("feature_importance")
def feature_importance(spark, d):
    rows = M.assemble(lines(spark, d), LINE_COLUMNS)
    return M.importances(M.classifier("forest", numTrees=5, maxDepth=4).fit(rows), LINE_COLUMNS, spark)


@query("feature_subset_eval")
def feature_subset_eval(spark, d):
    rows = cut_lineage(lines(spark, d))
    subsets = {"all": LINE_COLUMNS, "no price": [c for c in LINE_COLUMNS if c != "l_extendedprice"], "price only": ["l_extendedprice"]}
    return M.subset_scores(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), subsets, "tree", maxDepth=4)


@query("missing_impact")
def missing_impact(spark, d):
    """Sensitivity, specificity and threshold of a tree for each pair of missing-data cut-offs, next to what is left."""
    sheet = cohort.sheet(spark, d).withColumns({"status": F.when(F.col("status") == "F", 1.0).when(F.col("status") == "O", 0.0), "prio": F.length("prio").cast("double")})
    sheet = sheet.withColumn("label", (F.col("price") > 300000).cast("double")).where(F.col("label").isNotNull()).withColumn("split", Y.hash_split(F.col("id"), 0.8))
    sheet = cut_lineage(sheet)
    columns = ["price", "cust", "status", "prio"]
    shares = PR.column_shares(sheet, columns)
    out = None
    for column_cut in (50, 20):
        kept = [c for c in columns if shares[c] < column_cut]
        for row_cut in (50, 20):
            rows = M.assemble(PR.keep_complete_rows(sheet, kept, row_cut).fillna(0.0, kept), kept)
            predicted = M.fit_predict(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), "tree", ["id"], maxDepth=3)
            best = E.best_threshold(E.threshold_sweep(predicted, "confidence", "y_true")).select(
                F.lit(column_cut).alias("column_cutoff"), F.lit(row_cut).alias("row_cutoff"), F.lit(len(kept)).alias("n_features"), "*")
            out = best if out is None else out.unionByName(best)
    return out


@query("pca")
def pca(spark, d):
    rows = M.vectors(table(spark, d, "embeddings"), "embedding")
    _, components, inertia = R.principal_components(rows, "vec_id", [f"x{i}" for i in range(64)], 5)
    top = R.correlation_circle(components, 1, 2).select(F.lit("variable").alias("kind"), F.col("feature").alias("name"), F.col("norm").alias("value"))
    return inertia.select(F.lit("inertia").alias("kind"), F.col("axis").cast("string").alias("name"), F.col("share").alias("value")).unionByName(top)


@query("mca")
def mca(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return R.multiple_correspondence(rows, "o_orderkey", ["o_orderstatus", "o_orderpriority"], 4)[2]


@query("famd")
def famd(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", *LINE_COLUMNS, "l_returnflag", "l_linestatus")
    return R.contributions(R.mixed_data(rows, "l_orderkey", LINE_COLUMNS, ["l_returnflag", "l_linestatus"], 3)[1])
