"""Source and sink queries."""

from pyspark.sql import functions as F

from carnet import constants as K
from carnet.plans import inputs as I
from carnet.plans import sqlparts as S
from carnet.plans.vocabulary import SQL_ALL, all_suggestions
from carnet.registry import query, table
from carnet.session import work_path
from carnet.sources import readers as R
from carnet.sources import sinks as W


@query("src_table", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def src_table(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.normalize_columns(orders.toDF(" o_orderkey", "o_custkey ", "\to_orderstatus "))


@query("src_alias", """
    SELECT trim(p_name) AS token_source, '' AS match, p_size AS count, p_retailprice AS score, NULL::INT AS edit_dist, '' AS note, trim(p_brand) AS expansions
    FROM part WHERE upper(trim(p_type)) = 'ECONOMY' AND trim(p_name) <> ''""")
def src_alias(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias(" Token "), F.col("p_size").alias("freq"), F.col("p_retailprice").alias("Similarity"),
                                         F.col("p_brand").alias("choices"), F.col("p_type").alias("Category"))
    return R.read_suggestions(part, "economy")


@query("src_token_csv", f"""
    SELECT DISTINCT p_name AS token_source, 0 AS count, CAST(regexp_matches(lower(trim(p_name)), '^[{S.LET}]+$') AS INT) AS word_like, 0.0::DOUBLE AS zipf FROM part""")
def src_token_csv(spark, d):
    return R.with_token_defaults(table(spark, d, "part").select(F.col("p_name").alias("token")).distinct())


@query("src_dict", f"""
    SELECT DISTINCT key, value, CASE WHEN regexp_matches(key, '{S.SP}') THEN 'phrase' ELSE 'single' END AS kind
    FROM (SELECT {S.strip('lower(p_name)')} AS key, {S.strip('p_type')} AS value FROM part UNION ALL SELECT {S.strip('lower(p_brand)')}, {S.strip('upper(p_name)')} FROM part)
    WHERE key <> '' AND value <> ''""")
def src_dict(spark, d):
    json = F.to_json(F.map_from_arrays(F.array("p_name", "p_brand"), F.array("p_type", F.upper("p_name"))))
    return R.parse_dictionary(table(spark, d, "part").select(json.alias("json")), "json").distinct()


@query("src_list_map", """
    SELECT DISTINCT upper(p_brand) AS key, CASE WHEN p_size % 2 = 0 THEN p_type || ' | ' || p_name ELSE p_name END AS expansions FROM part""")
def src_list_map(spark, d):
    listed = F.to_json(F.map_from_arrays(F.array("p_brand"), F.array(F.array("p_type", "p_name"))))
    single = F.to_json(F.map_from_arrays(F.array("p_brand"), F.array("p_name")))
    rows = table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, listed).otherwise(single).alias("json"))
    return R.parse_list_map(rows, "json").select("key", F.array_join("expansions", " | ").alias("expansions")).distinct()


@query("src_lines", rf"""
    SELECT doc_id, line AS text FROM (SELECT doc_id, {S.strip('unnest(regexp_split_to_array(text, chr(13) || chr(63) || chr(10)))')} AS line FROM documents) WHERE line <> ''""")
def src_lines(spark, d):
    return R.lines_of(table(spark, d, "documents"), "text", "doc_id")


@query("src_required", "SELECT doc_id, n_chars FROM documents")
def src_required(spark, d):
    """Input files and columns are checked before the plan is built."""
    R.require_paths(spark, [f"{d}/documents.parquet"])
    return R.require_columns(table(spark, d, "documents"), ["doc_id", "n_chars"]).select("doc_id", "n_chars")


@query("ingest_inclusion", """
    SELECT c_custkey::VARCHAR AS num_inclusion, c_mktsegment || '-' || c_nationkey AS ipp FROM customer WHERE c_nationkey <> 0""")
def ingest_inclusion(spark, d):
    ipp = F.when(F.col("c_nationkey") == 0, "   ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")))
    return R.ingest_inclusion(table(spark, d, "customer").select(F.col("c_custkey").alias("NUM_INCLUSION"), ipp.alias("*IPP*")), "NUM_INCLUSION", "*IPP*")


@query("ingest_sheet", "SELECT o_orderkey, o_custkey::VARCHAR AS num_inclusion, o_orderstatus AS target FROM orders")
def ingest_sheet(spark, d):
    sheet = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("Numéro anonymat"), F.concat(F.lit(" "), "o_orderstatus").alias("Diag endo profonde *"))
    return R.ingest_sheet(sheet, "Numéro anonymat", "diag endo profonde").select("o_orderkey", "num_inclusion", "target")


@query("ingest_notes", """
    SELECT user_id::VARCHAR AS ipp, strftime(ts, '%Y-%m-%d') AS date_consultation, event_type AS diag_gyneco FROM events WHERE event_type <> 'view'""")
def ingest_notes(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("#IPP"), F.to_date("ts").alias("Date consultation"),
                                           F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("  ").alias("Consultation"))
    return R.ingest_notes(rows, "#IPP", "Date consultation", "Consultation")


SQL_CODES = """SELECT p_partkey::VARCHAR AS num_inclusion, concat_ws(' - ', CASE WHEN p_size >= 5 THEN p_brand END, CASE WHEN p_size <= 45 THEN p_type END) AS diag_item
    FROM part WHERE p_size >= 5 OR p_size <= 45"""


def coded_parts(spark, d):
    code = F.when(F.col("p_size") >= 5, F.col("p_brand")).otherwise("")
    label = F.when(F.col("p_size") <= 45, F.concat(F.col("p_type"), F.lit(" ")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("NUM_INCLUSION"), code.alias("CIMCD"), label.alias("CIM_LIBELLE_COMPLET"))


@query("ingest_codes", SQL_CODES)
def ingest_codes(spark, d):
    return R.ingest_codes(coded_parts(spark, d), "NUM_INCLUSION", "CIMCD", "CIM_LIBELLE_COMPLET")


@query("code_label", """SELECT p_partkey, concat_ws(' - ', CASE WHEN p_size >= 5 THEN p_brand END, CASE WHEN p_size <= 45 THEN p_type END) AS label FROM part""")
def code_label(spark, d):
    return coded_parts(spark, d).select(F.col("NUM_INCLUSION").alias("p_partkey"), R.code_label(F.col("CIMCD"), F.col("CIM_LIBELLE_COMPLET")).alias("label"))


@query("sink_suggest", SQL_ALL + "SELECT category, count(*) AS n, CAST(sum(count) AS BIGINT) AS occurrences FROM allsug GROUP BY category")
def sink_suggest(spark, d):
    """Suggestions are written one folder per family, then read back and counted."""
    path = work_path(spark, "suggestions")
    W.write_suggestions(all_suggestions(spark, d), path)
    return spark.read.parquet(path).groupBy("category").agg(F.count("*").alias("n"), F.sum("count").alias("occurrences"))


@query("sink_export", """
    WITH p AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant' AND length(text) > 300) AS a, arg_min(text, turn) FILTER (role = 'user' AND length(text) > 100) AS b
               FROM conversations GROUP BY conv_id)
    SELECT '1.0' AS schema_version, '2024-01-01T00:00:00' AS exported_at, conv_id AS patient_id, CASE WHEN trim(a) <> '' THEN a ELSE coalesce(b, '') END AS text_after FROM p""")
def sink_export(spark, d):
    """The last long answer of a conversation is its saved text, the first longer question its source text; either may be missing."""
    notes = table(spark, d, "conversations").withColumnRenamed("conv_id", "patient_id")
    saved = notes.where((F.col("role") == "assistant") & (F.length("text") > 300)).groupBy("patient_id").agg(F.max_by("text", "turn").alias("text_after"))
    source = notes.where((F.col("role") == "user") & (F.length("text") > 100)).groupBy("patient_id").agg(F.min_by("text", "turn").alias("text"))
    return W.export_rows(notes.select("patient_id").distinct(), saved, source, "2024-01-01T00:00:00")


@query("sink_run_meta")
def sink_run_meta(spark, d):
    """Predictions of the keyword scorer with the metadata record of the run."""
    from carnet.operators import labelling as L

    predicted = L.infer(table(spark, d, "documents"), ["doc_id"], "text", L.keyword_scorer(("auxeau",), ("thth",)))
    return W.write_run(predicted, work_path(spark, "run"), model="keyword", task="symptoms", answers=list(K.ANSWERS))
