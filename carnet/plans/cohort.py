"""Cohort profiling and univariate statistics queries."""

from pyspark.sql import functions as F

from carnet import constants as K
from carnet.operators import profile as M
from carnet.operators import records as P
from carnet.operators import stats as Z
from carnet.operators.ranking import top_per_group
from carnet.registry import query, table

SHEET_COLUMNS = ["price", "cust", "status", "prio", "flag"]


def sheet(spark, d):
    """Orders as a structured sheet with gaps in four of five columns."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") >= 90000, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("cust"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(~F.col("o_orderpriority").isin("5-LOW", "3-MEDIUM", "2-HIGH"), F.col("o_orderpriority")).alias("prio"), (F.col("o_orderkey") % 2).cast("int").alias("flag"))


SQL_SHEET = """
    sheet AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 90000 THEN o_totalprice END AS price, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS cust,
              CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
              CASE WHEN o_orderpriority NOT IN ('5-LOW', '3-MEDIUM', '2-HIGH') THEN o_orderpriority END AS prio, CAST(o_orderkey % 2 AS INT) AS flag FROM orders)"""
SQL_SHARES = SQL_SHEET + ", shares AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS pct FROM sheet" for c in SHEET_COLUMNS) + ")"
NULLS = {c: f"CAST({c} IS NULL AS INT)" for c in SHEET_COLUMNS}
N_MISSING = " + ".join(NULLS.values())


@query("miss_by_column", f"WITH {SQL_SHARES} SELECT column_name, round(pct, 6) AS percent_missing FROM shares")
def miss_by_column(spark, d):
    return M.percent_missing(sheet(spark, d), SHEET_COLUMNS)


@query("miss_by_patient", f"WITH {SQL_SHEET} SELECT id, {N_MISSING} AS n_missing, round(100.0::DOUBLE * ({N_MISSING}) / 5, 6) AS percent_missing FROM sheet")
def miss_by_patient(spark, d):
    return M.missing_by_row(sheet(spark, d), "id", SHEET_COLUMNS)


@query("miss_filter_patient", f"WITH {SQL_SHEET} SELECT * FROM sheet WHERE {N_MISSING} <= 1")
def miss_filter_patient(spark, d):
    return M.keep_complete_rows(sheet(spark, d), SHEET_COLUMNS)


@query("miss_filter_column", f"WITH {SQL_SHEET} SELECT id, price, cust, status, flag FROM sheet")
def miss_filter_column(spark, d):
    """Columns half empty or more go: only the priority column."""
    return M.keep_complete_columns(sheet(spark, d), SHEET_COLUMNS, 50.0)


COLUMN_CUTOFFS, ROW_CUTOFFS = [None, 50, 40, 30, 20, 10], [50, 40, 30, 20, 10]
GRID_NULLS = " + ".join(f"CAST({c} IS NULL AND c{i} AS INT)" for i, c in enumerate(SHEET_COLUMNS))


@query("miss_cutoff_grid", f"""WITH {SQL_SHARES},
    cuts(column_cutoff, cut) AS (VALUES ('none', 1000), ('50', 50), ('40', 40), ('30', 30), ('20', 20), ('10', 10)), rcuts(row_cutoff) AS (VALUES (50), (40), (30), (20), (10)),
    k AS (SELECT column_cutoff, {', '.join(f"(SELECT pct < cut FROM shares WHERE column_name = '{c}') AS c{i}" for i, c in enumerate(SHEET_COLUMNS))} FROM cuts),
    n AS (SELECT *, {' + '.join(f'c{i}::INT' for i in range(5))} AS n_features FROM k)
    SELECT column_cutoff, row_cutoff::DOUBLE AS row_cutoff, n_features, count(*) FILTER (100.0 * ({GRID_NULLS}) / greatest(n_features, 1) <= row_cutoff) AS n_rows
    FROM n, rcuts, sheet GROUP BY ALL""")
def miss_cutoff_grid(spark, d):
    return M.cutoff_grid(sheet(spark, d), SHEET_COLUMNS, COLUMN_CUTOFFS, ROW_CUTOFFS)


@query("miss_steps", f"""WITH {SQL_SHARES}, steps(step) AS (VALUES (90), (80), (70), (60), (50), (40), (30), (20), (10)),
    k AS (SELECT step, {', '.join(f"(SELECT pct > 0 AND pct < step FROM shares WHERE column_name = '{c}') AS c{i}" for i, c in enumerate(SHEET_COLUMNS))},
          (SELECT count(*) FROM shares WHERE pct < step) AS n FROM steps)
    SELECT id, step::DOUBLE AS step, CAST(n AS INT) AS n_columns, {GRID_NULLS} AS n_missing, round(100.0::DOUBLE * ({GRID_NULLS}) / 5, 6) AS percent_missing FROM k, sheet""")
def miss_steps(spark, d):
    return M.missing_steps(sheet(spark, d), "id", SHEET_COLUMNS, [90, 80, 70, 60, 50, 40, 30, 20, 10])


@query("coverage_count", f"WITH {SQL_SHEET} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_known, count({c}) >= 75 AS enough FROM sheet" for c in SHEET_COLUMNS))
def coverage_count(spark, d):
    return M.coverage(sheet(spark, d), SHEET_COLUMNS)


@query("complete_cells", f"""WITH {SQL_SHEET}
    SELECT count(*) * 5 AS total_cells, CAST(sum(5 - ({N_MISSING})) AS BIGINT) AS known_cells, count(*) FILTER ({N_MISSING} = 0) * 5 AS complete_row_cells FROM sheet""")
def complete_cells(spark, d):
    return M.complete_cells(sheet(spark, d), SHEET_COLUMNS)


@query("group_split", """
    WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_type, CAST(least(9, floor((value - lo) / ((hi - lo) / 10))) AS INT) AS bin, count(*) AS n, min(value) AS low, max(value) AS high FROM events, l GROUP BY ALL""")
def group_split(spark, d):
    return M.group_histogram(table(spark, d, "events"), "event_type", "value")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_pairs", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]))
def corr_pairs(spark, d):
    return Z.correlation_pairs(table(spark, d, "lineitem"), NUMERIC)


def outcome_lines(spark, d):
    """Line items with a binary outcome (returned) and categorical features."""
    lines = table(spark, d, "lineitem")
    return lines.select(*NUMERIC, (F.col("l_returnflag") == "R").cast("int").alias("outcome"), F.col("l_linestatus").alias("status"),
                        F.col("l_linenumber").alias("line"), (F.col("l_quantity") > 25).cast("int").alias("big"), F.floor(F.col("l_discount") * 100 / 3).cast("int").alias("band"))


SQL_LINES = f"""
    x AS (SELECT {', '.join(NUMERIC)}, CAST(l_returnflag = 'R' AS INT) AS outcome, l_linestatus AS status, l_linenumber AS line, CAST(l_quantity > 25 AS INT) AS big,
          CAST(floor(l_discount * 100 / 3) AS INT) AS band FROM lineitem)"""


def sql_per_feature(features, select):
    return " UNION ALL ".join(select.format(f=f) for f in features)


@query("ttest_groups", f"WITH {SQL_LINES} " + sql_per_feature(NUMERIC, """
    SELECT '{f}' AS feature, n0, n1, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) AS t, n0 + n1 - 2 AS dof
    FROM (SELECT count({f}) FILTER (outcome = 0) AS n0, count({f}) FILTER (outcome = 1) AS n1, avg({f}) FILTER (outcome = 0) AS m0, avg({f}) FILTER (outcome = 1) AS m1,
          var_samp({f}) FILTER (outcome = 0) AS v0, var_samp({f}) FILTER (outcome = 1) AS v1 FROM x)"""))
def ttest_groups(spark, d):
    return Z.t_statistics(outcome_lines(spark, d), NUMERIC, "outcome")


@query("ttest_p")
def ttest_p(spark, d):
    return Z.t_tests(outcome_lines(spark, d), NUMERIC, "outcome")


CATEGORICAL = ["status", "line", "big", "band"]
SQL_CELLS = SQL_LINES + ", cells AS (" + sql_per_feature(CATEGORICAL, "SELECT '{f}' AS feature, {f}::VARCHAR AS value, outcome AS cls, count(*)::DOUBLE AS n FROM x GROUP BY ALL") + """),
    m AS (SELECT *, sum(n) OVER (PARTITION BY feature, value) AS r, sum(n) OVER (PARTITION BY feature, cls) AS c, sum(n) OVER (PARTITION BY feature) AS t FROM cells)"""


@query("chi2_contingency", f"""WITH {SQL_CELLS},
    g AS (SELECT feature, t, count(DISTINCT value) AS nv, count(DISTINCT cls) AS nc, sum(n * n * t / (r * c)) - t AS plain,
                 sum(greatest(abs(n - r * c / t) - 0.5, 0) * greatest(abs(n - r * c / t) - 0.5, 0) * t / (r * c)) AS yates FROM m GROUP BY feature, t)
    SELECT feature, round(CASE WHEN nv = 2 AND nc = 2 THEN yates ELSE plain END, 6) AS chi2, (nv - 1) * (nc - 1) AS dof FROM g""")
def chi2_contingency(spark, d):
    return Z.chi2_statistics(outcome_lines(spark, d), CATEGORICAL, "outcome")


@query("chi2_p")
def chi2_p(spark, d):
    return Z.chi2_tests(outcome_lines(spark, d), CATEGORICAL, "outcome")


@query("crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P FROM orders GROUP BY 1")
def crosstab(spark, d):
    return Z.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("kbest_chi2", f"WITH {SQL_LINES} " + sql_per_feature(NUMERIC, """
    SELECT '{f}' AS feature, round((o0 - e0) * (o0 - e0) / e0 + (o1 - e1) * (o1 - e1) / e1, 4) AS score FROM (SELECT o0, o1, (o0 + o1) * r0 / (r0 + r1) AS e0, (o0 + o1) * r1 / (r0 + r1) AS e1
    FROM (SELECT sum({f}) FILTER (outcome = 0) AS o0, sum({f}) FILTER (outcome = 1) AS o1, count(*) FILTER (outcome = 0) AS r0, count(*) FILTER (outcome = 1) AS r1 FROM x))"""))
def kbest_chi2(spark, d):
    return Z.select_chi2(outcome_lines(spark, d), NUMERIC, "outcome")


@query("kbest_f", f"WITH {SQL_LINES} " + sql_per_feature(NUMERIC, """
    SELECT '{f}' AS feature, round((n0 * (m0 - g) * (m0 - g) + n1 * (m1 - g) * (m1 - g)) / (((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 4) AS score
    FROM (SELECT count(*) FILTER (outcome = 0) AS n0, count(*) FILTER (outcome = 1) AS n1, avg({f}) FILTER (outcome = 0) AS m0, avg({f}) FILTER (outcome = 1) AS m1, avg({f}) AS g,
          var_samp({f}) FILTER (outcome = 0) AS v0, var_samp({f}) FILTER (outcome = 1) AS v1 FROM x)"""))
def kbest_f(spark, d):
    return Z.select_f(outcome_lines(spark, d), NUMERIC, "outcome")


@query("kbest_mi", f"WITH {SQL_CELLS} SELECT feature, round(sum(n / t * ln(n * t / (r * c))), 6) AS score FROM m GROUP BY feature")
def kbest_mi(spark, d):
    return Z.select_mi(outcome_lines(spark, d), CATEGORICAL, "outcome")


@query("impute", f"""WITH {SQL_SHEET},
    top AS (SELECT prio FROM sheet WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)
    SELECT id, coalesce(price, (SELECT avg(price) FROM sheet)) AS price_mean, coalesce(price, (SELECT median(price) FROM sheet)) AS price_median, coalesce(prio, (SELECT prio FROM top)) AS prio FROM sheet""".replace(
        "coalesce(price, (SELECT avg(price) FROM sheet))", "round(coalesce(price, (SELECT avg(price) FROM sheet)), 4)"))
def impute(spark, d):
    rows = sheet(spark, d).select("id", F.col("price").alias("price_mean"), F.col("price").alias("price_median"), "prio")
    rows = Z.impute(Z.impute(Z.impute(rows, ["price_mean"], "mean"), ["price_median"], "median"), ["prio"], "most_frequent")
    return rows.withColumn("price_mean", F.round("price_mean", 4))


STATUSES, PRIORITIES = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("onehot", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderpriority = '{p}' AS INT) AS \"prio_{p}\"" for p in PRIORITIES[:4]) + ", CAST(o_orderpriority = '5-LOW' AS INT) AS prio_aucun FROM orders")
def onehot(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "0").otherwise(F.col("o_orderpriority")).alias("prio"))
    return Z.one_hot(rows, "prio")


@query("encode_targets", "SELECT o_orderkey, o_custkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS o_orderstatus_code, " + ", ".join(
    f"CAST(o_orderpriority = '{p}' AS INT) AS \"o_orderpriority_{p}\"" for p in PRIORITIES) + " FROM orders")
def encode_targets(spark, d):
    """Status as ordinal code, priority as dummies: both encoders."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return Z.encode_targets(Z.encode_targets(rows, ["o_orderstatus"], False), ["o_orderpriority"], True)


@query("head_per_class", "SELECT event_type, event_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 50")
def head_per_class(spark, d):
    return top_per_group(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], [F.col("event_id")], 50)


@query("ordinal_encode", "SELECT p_partkey, p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INT) AS p_name_code FROM part")
def ordinal_encode(spark, d):
    return Z.ordinal_encode(table(spark, d, "part").select("p_partkey", "p_name"), "p_name")


LINE_KINDS = {"numeric": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMERIC], "text": ["l_returnflag", "l_linestatus"], "date": ["l_shipdate"]}


@query("column_kinds", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_known, '{kind}' AS kind FROM lineitem" for kind, names in LINE_KINDS.items() for c in names))
def column_kinds(spark, d):
    """Kind and number of known cells of every lineitem column."""
    lines = table(spark, d, "lineitem")
    kind_of = {c: kind for kind, names in Z.column_kinds(lines).items() for c in names}
    counts = lines.agg(*[F.count(c).alias(c) for c in lines.columns])
    names = F.create_map(*[F.lit(x) for pair in kind_of.items() for x in pair])
    return P.row_to_long(counts, "column_name", "n_known").withColumn("kind", F.element_at(names, F.col("column_name")))


@query("standard_scale", """
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity,
           round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) AS l_tax FROM lineitem""")
def standard_scale(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    scaled = Z.standard_scale(lines, ["l_quantity", "l_tax"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


@query("feature_exclusions", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_known, count({c}) >= 75 AS enough FROM lineitem" for c in ("l_quantity", "l_discount")))
def feature_exclusions(spark, d):
    """Line item columns in order, two declared pairs: extended price goes with quantity, tax with discount."""
    kept = Z.at_most_one_of_pair(NUMERIC, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])
    return M.coverage(table(spark, d, "lineitem"), kept)


@query("drop_anapath", "SELECT o_orderkey, o_custkey FROM orders")
def drop_anapath(spark, d):
    """Status, price and priority of an order stand for the leaking targets."""
    named = dict(zip(("o_orderstatus", "o_totalprice", "o_orderpriority"), K.LEAK_TARGETS))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", *named).withColumnsRenamed(named).drop(*K.LEAK_TARGETS)


@query("target_stages", """
    WITH t AS (SELECT least(1, deep1 + deep2 + other) AS any_disease, least(1, deep1 + deep2) AS deep, other FROM (
        SELECT CAST(o_orderstatus = 'F' AND o_custkey % 2 = 0 AS INT) AS deep1, CAST(o_orderpriority = '1-URGENT' AS INT) AS deep2, CAST(o_custkey % 5 = 0 AS INT) AS other FROM orders))
    SELECT count(*) AS n, CAST(sum(any_disease) AS BIGINT) AS n_any, count(*) FILTER (any_disease = 1 AND deep = 1) AS n_deep, count(*) FILTER (any_disease = 1 AND deep = 0) AS n_superficial FROM t""")
def target_stages(spark, d):
    """Any disease; deep among the positives; superficial for the rest of them."""
    flags = table(spark, d, "orders").select(
        ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 2 == 0)).cast("int").alias("deep1"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("deep2"),
        (F.col("o_custkey") % 5 == 0).cast("int").alias("other"))
    staged = flags.select(P.binarize(["deep1", "deep2", "other"]).alias("any"), P.binarize(["deep1", "deep2"]).alias("deep"))
    return staged.agg(F.count("*").alias("n"), F.sum("any").cast("long").alias("n_any"), F.count(F.when((F.col("any") == 1) & (F.col("deep") == 1), 1)).alias("n_deep"),
                      F.count(F.when((F.col("any") == 1) & (F.col("deep") == 0), 1)).alias("n_superficial"))


@query("drop_constant_labels", """
    WITH x AS (SELECT l.*, CAST(d.doc_id IS NOT NULL AS INT) AS described FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id))
    SELECT doc_id, quality, toxic FROM x""")
def drop_constant_labels(spark, d):
    """Every label row; that its document is there holds for all of them, so that label is constant."""
    docs = table(spark, d, "documents").select("doc_id").distinct().withColumn("described", F.lit(1))
    labels = table(spark, d, "labels").join(docs, "doc_id", "left").withColumn("described", F.coalesce("described", F.lit(0)))
    return labels.drop(*Z.constant_columns(labels, ["quality", "toxic", "described"]))


@query("get_cat_list", f"WITH {SQL_LINES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) <= 2 AS is_binary FROM x" for c in ["l_quantity", "l_tax", "outcome", "big", "line"]))
def get_cat_list(spark, d):
    return Z.binary_columns(outcome_lines(spark, d), ["l_quantity", "l_tax", "outcome", "big", "line"])
