"""Join, set and reconciliation queries."""

from pyspark.sql import functions as F

from carnet.functions import text as T
from carnet.operators import reconcile as J
from carnet.plans import sqlparts as S
from carnet.registry import query, table
from carnet.sources import readers as R


def comparison_inputs(spark, d):
    """Customers as included patients, order statuses as sheet, event types as notes, shipped part types as codes."""
    inclusion = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("num_inclusion"), F.col("c_custkey").cast("string").alias("ipp"))
    orders = table(spark, d, "orders")
    last = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("l"))
    target = F.when(F.col("l.o_orderstatus") == "F", " Oui").when(F.col("l.o_orderstatus") == "O", "non").otherwise(F.col("l.o_orderstatus"))
    sheet = last.select(F.col("o_custkey").cast("string").alias("num_inclusion"), target.alias("target"))
    notes = R.ingest_notes(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day", "event_type").select("ipp", "diag_gyneco")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    coded = lines.join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    codes = R.ingest_codes(coded, "o_custkey", "p_brand", "p_type")
    validations = table(spark, d, "customer").where(F.col("c_acctbal") > 9000).select(
        F.col("c_custkey").cast("string").alias("id_patiente"), F.lit("ok").alias("validation_statut"), F.col("c_mktsegment").alias("diagnostic_medical"))
    return inclusion, sheet, notes, codes, validations


SQL_COMPARISON = """
    sheet AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'VRAI' WHEN 'O' THEN 'FAUX' ELSE o_orderstatus END AS diag_recueil
              FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1),
    gyn AS (SELECT user_id, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS diag_gyneco FROM events GROUP BY user_id),
    pmsi AS (SELECT o_custkey, string_agg(DISTINCT p_brand || ' - ' || p_type, ' | ' ORDER BY p_brand || ' - ' || p_type) AS diag_pmsi
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey),
    cmp AS (SELECT c_custkey::VARCHAR AS id_patiente, diag_recueil, diag_gyneco, diag_pmsi, CASE WHEN c_acctbal > 9000 THEN 'ok' END AS validation_statut,
                   CASE WHEN c_acctbal > 9000 THEN c_mktsegment END AS diagnostic_medical
            FROM customer LEFT JOIN sheet ON sheet.o_custkey = c_custkey LEFT JOIN gyn ON gyn.user_id = c_custkey LEFT JOIN pmsi ON pmsi.o_custkey = c_custkey)"""


@query("join_diag_compare", f"WITH {SQL_COMPARISON} SELECT * FROM cmp")
def join_diag_compare(spark, d):
    return J.diagnosis_comparison(*comparison_inputs(spark, d))


@query("agg_distinct_concat", "SELECT user_id, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS items FROM events GROUP BY user_id")
def agg_distinct_concat(spark, d):
    return J.distinct_concat(table(spark, d, "events"), "user_id", "event_type", alias="items")


@query("join_inner_target", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_inner_target(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")


@query("align_ids", """
    WITH s AS (SELECT c_custkey FROM customer WHERE CAST(c_acctbal < 0 AS INT) + CAST(c_nationkey < 3 AS INT) <= 1)
    SELECT 'sheet' AS side, c_custkey AS id, count(*) AS n FROM s WHERE c_custkey IN (SELECT user_id FROM events) GROUP BY ALL
    UNION ALL SELECT 'notes', user_id, count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM s) GROUP BY ALL""")
def align_ids(spark, d):
    sheet = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("a"),
                                              F.when(F.col("c_nationkey") >= 3, F.col("c_nationkey")).alias("b"))
    notes = table(spark, d, "events").select(F.col("user_id").alias("id"))
    left, right = J.align_ids(sheet, notes, "id", ["a", "b"], max_missing=1)
    sides = left.select(F.lit("sheet").alias("side"), "id").unionByName(right.select(F.lit("notes").alias("side"), "id"))
    return sides.groupBy("side", "id").agg(F.count("*").alias("n"))


@query("lookup_split", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE left(md5(doc_id::VARCHAR), 1) < '8')")
def lookup_split(spark, d):
    train = table(spark, d, "documents").where(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").select("doc_id")
    return table(spark, d, "labels").join(train, "doc_id", "left_semi")


@query("semi_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def semi_in(spark, d):
    buyers = table(spark, d, "events").where(F.col("event_type") == "purchase").select(F.col("user_id").alias("o_custkey")).distinct()
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(buyers, "o_custkey", "left_semi")


@query("diag_filter_join", """
    WITH diag AS (SELECT l_orderkey AS stay, string_agg(DISTINCT p_name, ' | ' ORDER BY p_name) AS diagnosis FROM lineitem JOIN part ON p_partkey = l_partkey
                  WHERE contains(lower(p_name), 'ring') GROUP BY l_orderkey),
    kept AS (SELECT * FROM diag WHERE stay NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))
    SELECT o_orderkey AS stay, o_custkey AS patient, o_orderstatus AS act, diagnosis FROM orders JOIN kept ON stay = o_orderkey
    UNION ALL SELECT NULL, c_custkey, '-', 'known before' FROM customer WHERE c_acctbal < -900""")
def diag_filter_join(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    diagnoses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stay"), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, d, "orders")
    acts = orders.select(F.col("o_orderkey").alias("stay"), F.col("o_custkey").alias("patient"), F.col("o_orderstatus").alias("act"))
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("stay"))
    known = table(spark, d, "customer").where(F.col("c_acctbal") < -900).select(
        F.col("c_custkey").alias("patient"), F.lit("-").alias("act"), F.lit("known before").alias("diagnosis"))
    return J.keyword_stays(diagnoses, acts, "stay", "p_name", "ring", urgent, known)


@query("unique_split", "SELECT p_name, count(*) > 1 AS repeated FROM part GROUP BY p_name")
def unique_split(spark, d):
    return J.occurrence_split(table(spark, d, "part"), "p_name")


@query("set_intersect_ids", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)")
def set_intersect_ids(spark, d):
    both = table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "events").select("user_id"))
    return both.agg(F.count("*").alias("n"))


@query("set_diff_terms", f"""
    WITH t AS (SELECT toxic, unnest({S.tokens('text')}) AS term FROM documents JOIN labels USING (doc_id))
    SELECT DISTINCT term FROM t WHERE toxic = 1 AND term NOT IN (SELECT term FROM t WHERE toxic = 0)""")
def set_diff_terms(spark, d):
    """One pass: distinct terms carry a flag per group instead of two scans and an anti join."""
    labelled = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    terms = labelled.select("toxic", F.explode(F.array_distinct(T.norm_tokens(F.col("text")))).alias("term"))
    flags = terms.groupBy("term").agg(F.max("toxic").alias("hi"), F.min("toxic").alias("lo"))
    return flags.where((F.col("lo") == 1) & (F.col("hi") == 1)).select("term")


@query("union_concat", """
    SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def union_concat(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


def two_sources(spark, d):
    """Values of two variables per customer: from the account, and from its orders."""
    sheet = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).cast("string").alias("x"),
                                              F.when(F.col("c_nationkey") > 4, F.col("c_mktsegment")).alias("y"))
    notes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        (F.count("*") % 3).cast("string").alias("x"), F.when(F.count("*") > 5, F.lit("BUILDING")).alias("y"))
    return sheet, notes


SQL_TWO = """
    s AS (SELECT c_custkey AS id, (c_nationkey % 3)::VARCHAR AS x, CASE WHEN c_nationkey > 4 THEN c_mktsegment END AS y FROM customer),
    n AS (SELECT o_custkey AS id, (count(*) % 3)::VARCHAR AS x, CASE WHEN count(*) > 5 THEN 'BUILDING' END AS y FROM orders GROUP BY o_custkey)"""


@query("compare_sources", f"WITH {SQL_TWO} SELECT id, TRY_CAST(s.x AS INT) AS left_value, TRY_CAST(n.x AS INT) AS right_value FROM s JOIN n USING (id)")
def compare_sources(spark, d):
    sheet, notes = two_sources(spark, d)
    return J.compare_values(sheet, notes, "id", "x", "x")


@query("match_rate", f"""WITH {SQL_TWO}
    SELECT 'x' AS variable, round(avg(CAST(s.x IS NOT DISTINCT FROM n.x AS DOUBLE)), 6) AS match_rate FROM s JOIN n USING (id)
    UNION ALL SELECT 'y', round(avg(CAST(s.y IS NOT DISTINCT FROM n.y AS DOUBLE)), 6) FROM s JOIN n USING (id)""")
def match_rate(spark, d):
    sheet, notes = two_sources(spark, d)
    return J.match_rate(sheet, notes, "id", ["x", "y"])


@query("synth_priority", f"WITH {SQL_TWO} SELECT id, coalesce(n.x, s.x) AS x, coalesce(n.y, s.y) AS y FROM s FULL JOIN n USING (id)")
def synth_priority(spark, d):
    sheet, notes = two_sources(spark, d)
    return J.merge_by_priority(notes, sheet, "id", ["x", "y"])


def change_log(spark, d):
    """Events as a change log: purchases save a text, errors validate it."""
    events = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    action = F.when(F.col("event_type") == "purchase", "save").otherwise("validate")
    return events.select(F.col("user_id").cast("string").alias("id_patiente"), F.col("event_id").alias("seq"), action.alias("action"), F.col("props").alias("text"),
                         F.col("event_type").alias("user"))


SQL_LATEST = """
    log AS (SELECT user_id::VARCHAR AS id_patiente, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'save' ELSE 'validate' END AS action, props AS text, event_type AS usr
            FROM events WHERE event_type IN ('purchase', 'error')),
    cur AS (SELECT *, row_number() OVER (PARTITION BY id_patiente ORDER BY seq DESC) AS r FROM log),
    sav AS (SELECT id_patiente, text, row_number() OVER (PARTITION BY id_patiente ORDER BY seq DESC) AS r FROM log WHERE action = 'save'),
    corr AS (SELECT c.id_patiente, s.text AS texte_apres, CASE WHEN action = 'validate' THEN 'corrections_validees' ELSE 'corrections_en_cours' END AS status_texte, usr AS updated_by,
                    CASE WHEN action = 'validate' THEN usr END AS validated_by, CASE WHEN action = 'validate' THEN seq END AS validated_seq
             FROM cur c LEFT JOIN sav s ON s.id_patiente = c.id_patiente AND s.r = 1 WHERE c.r = 1)"""


@query("latest_correction", f"WITH {SQL_LATEST} SELECT * FROM corr")
def latest_correction(spark, d):
    return J.latest_corrections(change_log(spark, d))


@query("patient_status", f"""WITH {SQL_COMPARISON}, {SQL_LATEST}
    SELECT c.id_patiente, CASE WHEN k.validated_seq IS NOT NULL THEN 'corrections_validees' WHEN c.id_patiente IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 9500) THEN 'corrections_validees'
        WHEN trim(k.status_texte) <> '' THEN k.status_texte WHEN trim(c.validation_statut) <> '' THEN c.validation_statut ELSE 'attente_correction' END AS status_texte
    FROM cmp c LEFT JOIN corr k USING (id_patiente)""")
def patient_status(spark, d):
    comparison = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id_patiente"), F.when(F.col("c_acctbal") > 9000, "ok").alias("validation_statut"))
    corrections = J.latest_corrections(change_log(spark, d)).withColumn("validated_at", F.col("validated_seq").cast("string"))
    validations = table(spark, d, "customer").where(F.col("c_acctbal") > 9500).select(F.col("c_custkey").cast("string").alias("id_patiente"), F.lit("2024-01-01").alias("date_validation"))
    return J.patient_status(comparison, corrections, validations)


@query("text_fallback", rf"""
    WITH j AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS b,
                      regexp_replace('Après' || chr(10) || arg_max(text, turn) FILTER (role = 'assistant' AND length(text) > 300), '(?i)^{S.SP}*après{S.SP}*\r?\n(\r?\n)?', '') AS a
               FROM conversations GROUP BY conv_id)
    SELECT conv_id, b AS text_before, CASE WHEN trim(a) <> '' THEN a ELSE b END AS text_after FROM j""")
def text_fallback(spark, d):
    """The first question is the source text; the last long answer, under a label, is the saved one."""
    notes = table(spark, d, "conversations")
    comparison = notes.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("text"))
    saved = notes.where((F.col("role") == "assistant") & (F.length("text") > 300)).groupBy("conv_id").agg(
        F.concat(F.lit("Après\n"), F.max_by("text", "turn")).alias("texte_apres"))
    return J.before_after(comparison, saved, "conv_id")


@query("text_source_pick", """
    SELECT conv_id AS patient_id, coalesce(CASE WHEN trim(c) <> '' THEN trim(c) END, r, '') AS text
    FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND length(text) > 300) AS c, arg_max(text, turn) FILTER (role = 'assistant') AS r FROM conversations GROUP BY conv_id)""")
def text_source_pick(spark, d):
    """The first long question is the combined text; without one, the latest answer is found by the mapped id."""
    notes = table(spark, d, "conversations")
    patients = notes.select(F.col("conv_id").alias("patient_id")).distinct()
    combined = notes.where((F.col("role") == "user") & (F.length("text") > 300)).groupBy(F.col("conv_id").alias("patient_id")).agg(F.min_by("text", "turn").alias("text"))
    ipp = F.concat(F.lit("I"), F.col("conv_id").cast("string")).alias("ipp")
    mapping = notes.select(F.col("conv_id").alias("patient_id"), ipp).distinct()
    raw = notes.where(F.col("role") == "assistant").select(ipp, F.col("turn").alias("note_date"), F.col("turn").alias("note_id"), "text")
    return J.source_texts(patients, combined, mapping, raw)


EDITED = S.join_sentences("list_transform(ss, lambda x, i: CASE WHEN i <= 2 THEN 'Edit: ' || x ELSE x END)")
PUT_BACK = S.join_sentences("list_transform(mine, lambda x, i: CASE WHEN i <= len(theirs) AND (i = idx + 1 OR i = 2 AND doc_id % 2 = 1) THEN theirs[i] ELSE x END)")


@query("correction_reset", f"""
    WITH a AS (SELECT doc_id, {S.sentences('text')} AS ss FROM documents),
    b AS (SELECT doc_id, CAST(doc_id % 3 AS INT) AS idx, {EDITED} AS saved, {S.join_sentences('ss')} AS engine FROM a),
    c AS (SELECT *, {S.sentences('saved')} AS mine, {S.sentences('engine')} AS theirs FROM b),
    r AS (SELECT doc_id, engine, (idx < len(mine) AND idx < len(theirs)) OR (doc_id % 2 = 1 AND len(mine) > 1 AND len(theirs) > 1) AS ok, saved, {PUT_BACK} AS put FROM c)
    SELECT doc_id, CASE WHEN ok THEN put ELSE saved END AS text FROM r WHERE NOT ok OR trim(put) <> trim(engine)""")
def correction_reset(spark, d):
    """Every document has a saved text with its first two sentences edited; sentence ``doc_id % 3`` is reset, in every
    other document the second one too."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    edited = F.transform(T.sentences(F.col("text")), lambda s, i: F.when(i < 2, F.concat(F.lit("Edit: "), s)).otherwise(s))
    saved = docs.select("doc_id", T.join_sentences(edited).alias("text"))
    resets = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("idx"))
    resets = resets.unionByName(docs.where(F.col("doc_id") % 2 == 1).select("doc_id", F.lit(1).alias("idx")))
    engine = docs.select("doc_id", T.join_sentences(T.sentences(F.col("text"))).alias("text"))
    return J.reset_sentences(saved, engine, resets, "doc_id")
