"""Projection, typing and record repair queries."""

from pyspark.sql import functions as F

from carnet.operators import records as P
from carnet.registry import query, table


@query("proj_drop", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def proj_drop(spark, d):
    sheet = table(spark, d, "orders").withColumn("empty", F.lit(None).cast("string"))
    return P.drop_columns_and_empty(sheet, ["o_totalprice", "o_orderdate", "o_orderpriority", "absent"])


@query("proj_rename", """
    SELECT o_orderkey, 'Stay' AS nature, 'Status' AS acte, o_orderstatus AS value FROM orders
    UNION ALL SELECT o_orderkey, 'Stay', 'Priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'Patient', '', o_custkey::VARCHAR FROM orders""")
def proj_rename(spark, d):
    sheet = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("Gynécologie > Stay>Status"),
                                            F.col("o_orderpriority").alias("Gynécologie > Stay>Priority"), F.col("o_custkey").alias("Patient"))
    return P.two_level(sheet, ["o_orderkey"], "Gynécologie > ")


@query("na_tokens", """
    SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus FROM orders""")
def na_tokens(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "NA").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
                                             F.when(F.col("o_orderstatus") == "P", "Nan").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return P.na_to_null(orders, ["o_orderpriority", "o_orderstatus"])


MIXED = """CASE event_id % 8 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%m/%d/%Y %H:%M:%S')
    WHEN 3 THEN 'Oui' WHEN 4 THEN 'FALSE' WHEN 5 THEN 'nan' WHEN 6 THEN event_type ELSE strftime(ts, '%Y-%m-%d') END"""


def mixed_cell():
    case = F.col("event_id") % 8
    return (F.when(case == 0, F.col("user_id").cast("string")).when(case == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(case == 2, F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
            .when(case == 3, "Oui").when(case == 4, "FALSE").when(case == 5, "nan").when(case == 6, F.col("event_type")).otherwise(F.date_format("ts", "yyyy-MM-dd")))


SQL_RETYPE = r"""CASE WHEN regexp_matches({v}, '^\d+$') THEN TRY_CAST({v} AS BIGINT) END AS v_long, {ts} AS v_ts,
    CASE WHEN lower({v}) IN ('true', 'oui') THEN true WHEN lower({v}) IN ('false', 'non') THEN false END AS v_bool,
    CASE WHEN NOT regexp_matches({v}, '^\d+$') AND {ts} IS NULL AND lower({v}) NOT IN ('true', 'oui', 'false', 'non', 'none', 'nan') THEN {v} END AS v_str"""
SQL_TS = r"""CASE WHEN length({v}) < 20 AND regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN try_strptime({v}, '%Y-%m-%d %H:%M:%S')
    WHEN length({v}) < 20 AND regexp_matches({v}, '^\d{{2}}/\d{{2}}/\d{{4}}') THEN try_strptime({v}, '%m/%d/%Y %H:%M:%S') END"""


@query("retype", f"WITH c AS (SELECT event_id, {MIXED} AS v FROM events) SELECT event_id, {SQL_RETYPE.format(v='v', ts=SQL_TS.format(v='v'))} FROM c")
def retype(spark, d):
    return table(spark, d, "events").select("event_id", P.retype(mixed_cell()).alias("t")).select("event_id", "t.*")


LONG_TS = f"coalesce({SQL_TS.format(v='v')}, CASE WHEN column_name LIKE '%Date%' THEN coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y')) END)"


@query("retype_all", f"""
    WITH c AS (SELECT event_id, 'Mixed' AS column_name, {MIXED} AS v FROM events UNION ALL SELECT event_id, 'Event Date', strftime(ts, '%d/%m/%Y') FROM events
               UNION ALL SELECT event_id, 'Type', event_type FROM events)
    SELECT event_id, column_name, {SQL_RETYPE.format(v='v', ts=LONG_TS)} FROM c""")
def retype_all(spark, d):
    sheet = table(spark, d, "events").select("event_id", mixed_cell().alias("Mixed"), F.date_format("ts", "dd/MM/yyyy").alias("Event Date"), F.col("event_type").alias("Type"))
    return P.retype_cells(P.to_long(sheet, ["event_id"]))


def yes_no_sheet(spark, d):
    """Text sheet: one yes / no column with gaps, one true / false column, one plain column."""
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "Oui").when(F.col("o_orderstatus") == "O", "NON").otherwise("Na").alias("a"),
        F.when(F.col("o_custkey") % 3 == 0, "True").when(F.col("o_custkey") % 3 == 1, "false").otherwise("NaN").alias("b"), F.col("o_orderpriority").alias("c"))


@query("bool_norm", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS a, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM orders""")
def bool_norm(spark, d):
    return P.split_boolean(yes_no_sheet(spark, d), ["o_orderkey"])[0]


@query("bool_count", """
    SELECT 'a' AS column_name, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS n_bool FROM orders
    UNION ALL SELECT 'b', count(*) FILTER (o_custkey % 3 < 2) FROM orders UNION ALL SELECT 'c', 0 FROM orders LIMIT 3""")
def bool_count(spark, d):
    return P.bool_cells(yes_no_sheet(spark, d).drop("o_orderkey"))


@query("diag_norm", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'VRAI' WHEN o_orderstatus = 'O' THEN 'FAUX' ELSE o_orderpriority END AS diag FROM orders""")
def diag_norm(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, " Oui ").otherwise("1")).when(
        F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "FAUX ").otherwise("0")).otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", P.diagnosis_flag(raw).alias("diag"))


@query("is_date_like", f"""
    WITH c AS (SELECT event_id, {MIXED} AS v FROM events)
    SELECT event_id, coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%d/%m/%Y %H:%M:%S')) IS NOT NULL AS date_like FROM c""")
def is_date_like(spark, d):
    return table(spark, d, "events").select("event_id", P.is_date_like(mixed_cell()).alias("date_like"))


@query("is_float_like", rf"""
    WITH c AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ' -1.5e3' ELSE {MIXED} END AS v FROM events)
    SELECT event_id, regexp_matches(v, '^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$') AS float_like FROM c""")
def is_float_like(spark, d):
    cell = F.when(F.col("event_id") % 9 == 0, " -1.5e3").otherwise(mixed_cell())
    return table(spark, d, "events").select("event_id", P.is_float_like(cell).alias("float_like"))


LABELLED = "documents LEFT JOIN labels USING (doc_id)"


def labelled(spark, d):
    """Documents with their labels; NULL where a document has none."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")


@query("binarize", f"SELECT doc_id, least(1, coalesce(quality, 0) + coalesce(toxic, 0)) AS any_flag FROM {LABELLED}")
def binarize(spark, d):
    return labelled(spark, d).select("doc_id", P.binarize(["quality", "toxic"]).alias("any_flag"))


@query("multiclass_shift", f"SELECT doc_id, CASE WHEN quality IS NULL THEN 2 ELSE quality + 1 END AS quality_class FROM {LABELLED}")
def multiclass_shift(spark, d):
    return labelled(spark, d).select("doc_id", P.multiclass_shift(F.col("quality")).alias("quality_class"))


@query("missing_code", f"SELECT doc_id, CASE WHEN coalesce(toxic, 2) = 2 THEN 0 ELSE toxic END AS toxic FROM {LABELLED}")
def missing_code(spark, d):
    return labelled(spark, d).select("doc_id", P.missing_to_zero(F.coalesce("toxic", F.lit(2))).alias("toxic"))


@query("label_name", f"SELECT doc_id, CASE WHEN toxic = 0 THEN 'absent' WHEN toxic = 1 THEN 'present' ELSE 'missing' END AS label FROM {LABELLED}")
def label_name(spark, d):
    return labelled(spark, d).select("doc_id", P.label_name(F.col("toxic")).alias("label"))


@query("multiclass_fill", f"SELECT doc_id, coalesce(quality, 2) AS quality, coalesce(toxic, 2) AS toxic FROM {LABELLED}")
def multiclass_fill(spark, d):
    return P.fill_missing_class(labelled(spark, d), ["quality", "toxic"])


@query("dropna_mode", f"""
    SELECT count(*) AS n_rows, count(quality + toxic) AS n_kept, round(100.0::DOUBLE * (count(*) - count(quality + toxic)) / count(*), 6) AS percent_lost FROM {LABELLED}""")
def dropna_mode(spark, d):
    return P.dropna_report(labelled(spark, d), ["quality", "toxic"])


@query("target_redefine", f"SELECT doc_id, CAST(toxic IS NOT NULL AS INT) AS information_present, toxic AS symptom_present FROM {LABELLED}")
def target_redefine(spark, d):
    return labelled(spark, d).select("doc_id", P.information_present(F.col("toxic")).alias("information_present"), F.col("toxic").alias("symptom_present"))


@query("malformed_find", """
    SELECT doc_id, 'text' AS column_name, replace(text, '. ', ';;') AS value FROM documents WHERE contains(text, chr(10)) AND contains(replace(text, '. ', ';;'), ';;')""")
def malformed_find(spark, d):
    """Documents in which every '. ' is an empty field; those with line breaks look like swallowed records."""
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(";;")).alias("text"), "lang")
    return P.find_malformed(docs, ["doc_id"])


@query("malformed_repair", """
    WITH s AS (SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS a, o_orderpriority AS b, o_orderkey % 50 = 0 AS bad, o_orderkey AS k FROM orders)
    SELECT id, a, b FROM s UNION ALL SELECT 'x' || id, a, '' FROM s WHERE bad UNION ALL SELECT 'y' || id, 'q', NULL FROM s WHERE bad""")
def malformed_repair(spark, d):
    """Every fiftieth order has two more records, one with extra fields and one too short, swallowed by its last cell."""
    key = F.col("o_orderkey").cast("string")
    swallowed = F.concat("o_orderpriority", F.lit("_x000D_\nx"), key, F.lit(";"), "o_orderstatus", F.lit(";;more\ny"), key, F.lit(";q"))
    sheet = table(spark, d, "orders").select(key.alias("id"), F.col("o_orderstatus").alias("a"),
                                            F.when(F.col("o_orderkey") % 50 == 0, swallowed).otherwise(F.col("o_orderpriority")).alias("b"))
    return P.repair_malformed(sheet, ["id", "a", "b"]).orderBy("id")


def multi_sheet(spark, d):
    """Conversation turns with their sentences in one cell, and the role once or twice in another."""
    notes = table(spark, d, "conversations")
    twice = F.when(F.col("turn") % 2 == 0, F.concat_ws(P.SEPARATOR, "role", "role")).when(F.col("turn") % 3 == 0, F.col("role"))
    return notes.select("conv_id", "turn", F.replace("text", F.lit(". "), F.lit(P.SEPARATOR)).alias("parts"), twice.alias("roles"))


SQL_MULTI = """
    o AS (SELECT conv_id, turn, string_split(replace(text, '. ', ' | '), ' | ') AS p, CASE WHEN turn % 2 = 0 THEN [role, role] WHEN turn % 3 = 0 THEN [role] ELSE [NULL] END AS f FROM conversations)"""


@query("multi_cell_detect", f"""WITH {SQL_MULTI}
    SELECT conv_id, turn, len(p) > 1 OR len(f) > 1 AS has_separator, CAST(greatest(len(p), len(f)) AS INT) AS n_values FROM o""")
def multi_cell_detect(spark, d):
    sheet = multi_sheet(spark, d)
    has = F.col("parts").contains(P.SEPARATOR) | F.coalesce(F.col("roles").contains(P.SEPARATOR), F.lit(False))
    return sheet.select("conv_id", "turn", has.alias("has_separator"), P.multi_value_count(["parts", "roles"]).alias("n_values"))


@query("multi_explode", f"""WITH {SQL_MULTI}
    SELECT conv_id, turn, CAST(i AS INT) AS pos, p[i + 1] AS parts, f[i + 1] AS roles FROM o, unnest(range(0, greatest(len(p), len(f)))) AS u(i)""")
def multi_explode(spark, d):
    return P.explode_multi(multi_sheet(spark, d), ["conv_id", "turn"], ["parts", "roles"])


@query("sep_column_scan", """
    SELECT 'text' AS column_name, bool_or(contains(text, '|')) AS has_separator FROM documents UNION ALL SELECT 'lang', bool_or(contains(lang, '|')) FROM documents
    UNION ALL SELECT 'source', bool_or(contains(source, '|')) FROM documents""")
def sep_column_scan(spark, d):
    return P.separator_columns(table(spark, d, "documents"))


def id_mapping(spark, d):
    keys = table(spark, d, "customer").where(F.col("c_acctbal") > 0)
    return keys.select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("P-"), F.col("c_custkey").cast("string")).alias("study_id"))


@query("id_map", """
    SELECT 'record' AS kind, event_id, CASE WHEN m.c_custkey IS NULL THEN user_id::VARCHAR ELSE 'P-' || user_id END AS id
    FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) m ON c_custkey = user_id
    UNION ALL SELECT 'unused', NULL, 'P-' || c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT user_id FROM events)""")
def id_map(spark, d):
    mapping = id_mapping(spark, d)
    events = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("id"))
    mapped = P.map_ids(events, "id", mapping).select(F.lit("record").alias("kind"), "event_id", "id")
    unused = P.unused_ids(mapping, events, "id").select(F.lit("unused").alias("kind"), F.lit(None).cast("long").alias("event_id"), F.col("study_id").alias("id"))
    return mapped.unionByName(unused)


@query("id_fix", "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN n_name ELSE s_nationkey::VARCHAR END AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def id_fix(spark, d):
    aliases = table(spark, d, "nation").where(F.col("n_nationkey") < 5).select(F.col("n_nationkey").cast("string").alias("source_id"), F.col("n_name").alias("study_id"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    return P.map_ids(rows, "nation", aliases)


@query("slice_rows", """
    SELECT event_id, ts, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) WHERE r <= 1000 OR r > 4000""")
def slice_rows(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    return P.slice_rows(events, [F.col("ts"), F.col("event_id")], 1000, 4000)
