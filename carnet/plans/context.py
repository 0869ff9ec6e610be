"""Keyword context, entities and labelling queries."""

from pyspark.sql import functions as F

from carnet import constants as K
from carnet.functions import text as T
from carnet.lookups import as_lookup
from carnet.operators import context as X
from carnet.operators import labelling as L
from carnet.plans import inputs as I
from carnet.plans import sqlparts as S
from carnet.registry import query, table


def sql_kwic(wanted, n, source="documents", keys="doc_id"):
    return rf"""
    WITH w AS (SELECT {keys}, regexp_extract_all(text, '[{S.W}]+') AS ws FROM {source}),
    h AS (SELECT {keys}, ws, u.w, CAST(u.p AS INT) - 1 AS pos FROM w, unnest(ws) WITH ORDINALITY AS u(w, p))
    SELECT {keys}, pos, array_to_string(ws[greatest(pos - {n}, 0) + 1 : pos + {n} + 1], ' ') AS context FROM h WHERE {wanted}"""


@query("kwic_prefix", sql_kwic("starts_with(lower(w), 'eau')", 5))
def kwic_prefix(spark, d):
    return X.kwic_prefix(table(spark, d, "documents"), ["doc_id"], "text", "eau")


@query("kwic_abbrev", sql_kwic("lower(w) = 'la'", 3))
def kwic_abbrev(spark, d):
    return X.kwic_word(table(spark, d, "documents"), ["doc_id"], "text", "LA")


KEYWORDS = "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS k FROM part UNION SELECT DISTINCT lower(o_orderstatus) || 'tionment' FROM orders"


@query("kwic_fuzzy", sql_kwic(rf"""EXISTS (SELECT 1 FROM ({KEYWORDS}) WHERE
    round(100.0 * (1 - levenshtein(strip_accents(lower(w)), k)::DOUBLE / greatest(length(strip_accents(lower(w))), length(k))), 2) >= 80)""", 10, "conversations", "conv_id, turn"))
def kwic_fuzzy(spark, d):
    """Words close to a part name, or to a status letter followed by 'tionment'."""
    return X.kwic_fuzzy(table(spark, d, "conversations"), ["conv_id", "turn"], "text", keywords(spark, d))


def keywords(spark, d):
    names = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("lex"))
    status = table(spark, d, "orders").select(F.concat(F.lower("o_orderstatus"), F.lit("tionment")).alias("lex"))
    return as_lookup(names.unionByName(status).distinct(), 20_000)


@query("kwic_fuzzy_indel")
def kwic_fuzzy_indel(spark, d):
    """The same keywords by the indel score on words as written."""
    return X.kwic_fuzzy(table(spark, d, "conversations"), ["conv_id", "turn"], "text", keywords(spark, d), scorer="indel")


@query("kwic_topics", rf"""
    WITH topics AS (SELECT DISTINCT item_id AS topic, t AS keyword FROM (SELECT item_id, unnest({S.tokens('text')}) AS t FROM benchmark) WHERE length(t) >= 5)
    SELECT doc_id, topic, count(DISTINCT keyword) AS n_keywords
    FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[{S.W}]+'))) AS keyword FROM documents) JOIN topics USING (keyword) GROUP BY ALL""")
def kwic_topics(spark, d):
    """Each benchmark passage is a topic, its longer words are the keywords."""
    words = F.filter(F.array_distinct(T.norm_tokens(F.col("text"))), lambda t: F.length(t) >= 5)
    topics = table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), F.explode(words).alias("keyword"))
    return X.topic_hits(table(spark, d, "documents"), ["doc_id"], "text", as_lookup(topics))


@query("kwic_topic_flags")
def kwic_topic_flags(spark, d):
    """The fixed medical topics, hit or no hit for every conversation turn."""
    return X.topic_flags(table(spark, d, "conversations"), ["conv_id", "turn"], "text", K.TOPICS, exact=K.TOPIC_ABBREVIATIONS)


def gazetteer(spark, d):
    """Terms: longer benchmark words by length class, and the two first words of each passage."""
    words = I.lexicon(spark, d).where(F.length("word") >= 7)
    label = F.when(F.length("word") % 3 == 0, "Médicament").when(F.length("word") % 3 == 1, "Symptômes").otherwise("Maladie")
    phrases = I.phrase_dictionary(spark, d).select(F.col("key").alias("term"), F.lit("Phrase").alias("label"))
    return words.select(F.col("word").alias("term"), label.alias("label")).unionByName(phrases)


SQL_ENTITIES = f"""{I.SQL_REFERENCE}, {I.SQL_PHRASES},
    gaz AS (SELECT w AS term, CASE length(w) % 3 WHEN 0 THEN 'Médicament' WHEN 1 THEN 'Symptômes' ELSE 'Maladie' END AS label FROM lex WHERE length(w) >= 7
            UNION ALL SELECT key, 'Phrase' FROM phrases),
    d AS (SELECT doc_id, {S.tokens('text')} AS ts FROM documents),
    g AS (SELECT doc_id, CAST(i AS INT) - 1 AS pos, array_to_string(ts[i:i + n - 1], ' ') AS term
          FROM d, (VALUES (1), (2), (3)) AS s(n), unnest(range(1, len(ts) - n + 2)) AS u(i)),
    ent AS (SELECT doc_id, pos, term, label, 1.0::DOUBLE AS score FROM g JOIN gaz USING (term)),
    uniq AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY pos, label) AS r FROM ent) WHERE r = 1),
    lab AS (SELECT uniq.*, quality, toxic FROM uniq JOIN labels USING (doc_id))"""


def entities(spark, d):
    return X.ngram_mentions(table(spark, d, "documents"), ["doc_id"], "text", as_lookup(gazetteer(spark, d)))


def labelled_entities(spark, d):
    return X.first_mentions(entities(spark, d), "doc_id").join(table(spark, d, "labels"), "doc_id")


query("ent_extract", f"WITH {SQL_ENTITIES} SELECT * FROM ent")(entities)


@query("ent_unique", f"WITH {SQL_ENTITIES} SELECT * FROM uniq")
def ent_unique(spark, d):
    return X.first_mentions(entities(spark, d), "doc_id")


@query("ent_group_freq", f"""WITH {SQL_ENTITIES}
    SELECT label, toxic, term, count(*) AS frequency, CAST(row_number() OVER (PARTITION BY label, toxic ORDER BY count(*) DESC, term) AS INT) AS rank
    FROM lab WHERE length(term) > 2 GROUP BY label, toxic, term QUALIFY row_number() OVER (PARTITION BY label, toxic ORDER BY count(*) DESC, term) <= 25""")
def ent_group_freq(spark, d):
    return X.group_frequency(labelled_entities(spark, d), "toxic", 25)


@query("ent_only_group", f"""WITH {SQL_ENTITIES}
    SELECT term, count(*) AS frequency, round(100.0 * count(*) / (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1), 6) AS percentage
    FROM lab WHERE toxic = 1 AND term NOT IN (SELECT term FROM lab WHERE toxic <> 1) GROUP BY term""")
def ent_only_group(spark, d):
    return X.only_in_group(labelled_entities(spark, d), "doc_id", "toxic", 1, table(spark, d, "labels"))


@query("ent_rel_freq", f"""WITH {SQL_ENTITIES},
    c AS (SELECT term, count(*) FILTER (toxic = 1) AS n_with, count(*) FILTER (toxic = 0) AS n_without FROM lab GROUP BY term)
    SELECT term, n_with, n_without, round(n_with::DOUBLE / (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1), 6) AS rel_with,
           round(n_without::DOUBLE / (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 0), 6) AS rel_without, n_with + n_without AS total
    FROM c WHERE n_with >= 10 OR n_without >= 10""")
def ent_rel_freq(spark, d):
    return X.relative_frequency(labelled_entities(spark, d), "doc_id", "toxic", table(spark, d, "labels"))


@query("ent_feature_table", f"""WITH {SQL_ENTITIES},
    top AS (SELECT term FROM lab GROUP BY term ORDER BY count(*) DESC, term LIMIT 20)
    SELECT term, count(*) FILTER (quality = 0) AS absent, count(*) FILTER (quality = 1) AS present FROM lab WHERE term IN (SELECT term FROM top) GROUP BY term""")
def ent_feature_table(spark, d):
    return X.feature_table(labelled_entities(spark, d), "quality")


SQL_CHUNKS = """
    n AS (SELECT doc_id, text, length(text) AS n FROM documents),
    s AS (SELECT doc_id, text, n, CASE WHEN n <= 1000 THEN [0] ELSE list_concat(list_transform(range(0, (n - 1000) // 800 + 1), lambda i: i * 800),
              CASE WHEN ((n - 1000) // 800) * 800 + 1000 < n THEN [n - 1000] ELSE [] END) END AS starts FROM n),
    chunks AS (SELECT doc_id, CAST(p AS INT) - 1 AS chunk, CAST(start AS INT) AS start, substr(text, start + 1, 1000) AS part
               FROM s, unnest(starts) WITH ORDINALITY AS u(start, p))"""


@query("doc_chunk", f"WITH {SQL_CHUNKS} SELECT * FROM chunks")
def doc_chunk(spark, d):
    """Windows of 1,000 characters, a fifth shared with the next one."""
    return L.chunk(table(spark, d, "documents"), ["doc_id"], "text", size=1000)


@query("chunk_vote", f"""WITH {SQL_CHUNKS},
    l AS (SELECT doc_id, chunk, CASE WHEN contains(part, 'auxe') THEN 'oui' WHEN contains(part, 'thth') THEN 'non' ELSE 'ambigue' END AS label,
                 'part ' || chunk AS reason FROM chunks),
    v AS (SELECT doc_id, bool_or(label = 'oui') AS y, bool_or(label = 'non') AS n, min(chunk) FILTER (label = 'oui') AS yc, min(chunk) FILTER (label = 'non') AS nc,
                 string_agg(reason, ' ' ORDER BY chunk) AS allr FROM l GROUP BY doc_id)
    SELECT doc_id, CASE WHEN y THEN 'oui' WHEN n THEN 'non' ELSE 'ambigue' END AS classification,
           CASE WHEN y THEN 'part ' || yc WHEN n THEN 'part ' || nc ELSE allr END AS justification FROM v""")
def chunk_vote(spark, d):
    parts = L.chunk(table(spark, d, "documents"), ["doc_id"], "text", size=1000)
    label = F.when(F.col("part").contains("auxe"), "oui").when(F.col("part").contains("thth"), "non").otherwise("ambigue")
    judged = parts.select("doc_id", "chunk", label.alias("label"), F.concat(F.lit("part "), F.col("chunk").cast("string")).alias("reason"))
    return L.vote(judged, ["doc_id"], "chunk", "label", "reason")


@query("resp_parse", """
    WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Label: oui' || chr(10) || text WHEN 1 THEN '  Non. ' || text WHEN 2 THEN text ELSE 'Réponse LABEL: AMBIGU LABEL: NON' END AS raw FROM documents)
    SELECT doc_id, CASE WHEN contains(upper(raw), 'LABEL: OUI') OR starts_with(ltrim(upper(raw)), 'OUI') THEN 'OUI'
        WHEN contains(upper(raw), 'LABEL: NON') OR starts_with(ltrim(upper(raw)), 'NON') THEN 'NON' ELSE 'AMBIGU' END AS prediction FROM r""")
def resp_parse(spark, d):
    raw = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Label: oui\n"), F.col("text"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("  Non. "), F.col("text")))
           .when(F.col("doc_id") % 4 == 2, F.col("text")).otherwise(F.lit("Réponse LABEL: AMBIGU LABEL: NON")))
    return table(spark, d, "documents").select("doc_id", L.parse_answer(raw).alias("prediction"))


@query("resp_parse_pair", r"""
    WITH r AS (SELECT conv_id, turn, string_split(trim('Classe: ' || role || chr(10) || 'Justification: ' || text), chr(10)) AS ls FROM conversations),
    s AS (SELECT conv_id, turn, ls[1] AS head, array_to_string(ls[2:], ' ') AS rest FROM r)
    SELECT conv_id, turn, lower(trim(split_part(head, ': ', 2))) AS classification, trim(substr(rest, strpos(rest, ': ') + 2)) AS justification FROM s""")
def resp_parse_pair(spark, d):
    raw = F.concat(F.lit("Classe: "), F.col("role"), F.lit("\nJustification: "), F.col("text"))
    answers = table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return L.with_pair(answers, "raw").drop("raw")


@query("prompt_build", "SELECT doc_id, '" + K.INSTRUCTION.replace("'", "''") + "' || chr(10) || 'Texte:' || chr(10) || text AS prompt FROM documents")
def prompt_build(spark, d):
    return table(spark, d, "documents").select("doc_id", L.prompt(F.col("text")).alias("prompt"))


@query("label_infer", """
    SELECT doc_id, CASE WHEN contains(lower(text), 'auxeau') THEN 'LABEL: OUI' || chr(10) || 'JUSTIF: mention'
        WHEN contains(lower(text), 'thth') THEN 'LABEL: NON' || chr(10) || 'JUSTIF: negation' ELSE 'LABEL: AMBIGU' || chr(10) || 'JUSTIF: rien' END AS raw,
        CASE WHEN contains(lower(text), 'auxeau') THEN 'OUI' WHEN contains(lower(text), 'thth') THEN 'NON' ELSE 'AMBIGU' END AS prediction FROM documents""")
def label_infer(spark, d):
    return L.infer(table(spark, d, "documents"), ["doc_id"], "text", L.keyword_scorer(("auxeau",), ("thth",)))


@query("class_sample", """
    SELECT o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= 20""")
def class_sample(spark, d):
    return L.class_sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 60)
