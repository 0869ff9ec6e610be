"""Vocabulary and suggestion queries."""

from pyspark.sql import functions as F

from carnet import constants as K
from carnet.functions import text as T
from carnet.lookups import as_lookup
from carnet.operators import suggest as G
from carnet.operators import vocab as V
from carnet.operators.nearest import nearest_words
from carnet.plans import inputs as I
from carnet.plans import sqlparts as S
from carnet.registry import query, table
from carnet.session import cut_lineage, work_path


@query("vocab_count", f"SELECT t AS token, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS t FROM documents) GROUP BY t")
def vocab_count(spark, d):
    return V.vocab_count(table(spark, d, "documents"), T.norm_tokens(F.col("text"))).orderBy(F.desc("n"), "token")


@query("vocab_set", rf"SELECT DISTINCT unnest(regexp_extract_all(text, '[{S.W}'']+')) AS word FROM documents")
def vocab_set(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct()


@query("vocab_word_class", rf"""
    WITH lex AS (SELECT DISTINCT unnest({S.tokens('text')}) AS w FROM benchmark),
    c AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest(list_filter(string_split(trim(regexp_replace(text, '{S.SP}+', ' ', 'g')), ' '), lambda t: t <> '')) AS t
          FROM documents) GROUP BY t),
    j AS (SELECT token, n, replace(token, '®', '') AS x, w FROM c LEFT JOIN lex ON w = lower(token))
    SELECT token, n, CASE WHEN regexp_matches(x, '^\p{{Nd}}+$') THEN 'number' WHEN regexp_matches(x, '^\p{{L}}+$') AND w IS NOT NULL THEN 'known'
        WHEN regexp_matches(x, '^\p{{L}}+$') THEN 'to_correct' WHEN regexp_matches(x, '\p{{Nd}}') THEN 'quantity' WHEN length(x) <= 1 THEN 'single'
        WHEN x LIKE '%°%' THEN 'degree' WHEN x LIKE '%³%' THEN 'volume' ELSE 'mixed' END AS kind
    FROM j""")
def vocab_word_class(spark, d):
    return V.with_word_class(V.vocab_count(table(spark, d, "documents"), I.raw_tokens(F.col("text"))), I.lexicon(spark, d))


@query("vocab_zipf", f"""
    WITH {I.SQL_REFERENCE}
    SELECT token, n, coalesce(z, 0.0) AS zipf
    FROM (SELECT t AS token, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS t FROM documents) GROUP BY t) LEFT JOIN zipfs ON t = token""")
def vocab_zipf(spark, d):
    counted = V.vocab_count(table(spark, d, "documents"), T.norm_tokens(F.col("text")))
    return V.with_zipf(counted, I.reference_counts(spark, d))


@query("vocab_validity", f"WITH {I.sql_token_table()} SELECT token, n, zipf, word_like, status FROM tok")
def vocab_validity(spark, d):
    return I.token_table(spark, d)


@query("vocab_short_freq", f"""
    SELECT t AS token, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({S.tokens('text')}) AS t FROM documents)
    WHERE length(t) BETWEEN 2 AND 4 AND regexp_matches(t, '^\\p{{L}}+$') GROUP BY t HAVING count(DISTINCT doc_id) > 2""")
def vocab_short_freq(spark, d):
    short = F.filter(T.norm_tokens(F.col("text")), lambda t: F.length(t).between(2, 4) & t.rlike(r"^\p{L}+$"))
    return V.doc_frequency(table(spark, d, "documents"), short).where(F.col("n_docs") > 2)


@query("vocab_abbrev_filter", rf"""
    WITH {I.sql_token_table(S.tokens('text'))}
    SELECT token, n FROM tok
    WHERE NOT (regexp_matches(token, '^\p{{Nd}}+$') OR length(token) <= 2 OR zipf >= 4.5 OR lower(token) IN {S.STOPWORDS})
      AND length(token) BETWEEN 3 AND 8
      AND (lower(token) IN {S.words_in(K.MEDICAL_WHITELIST)} OR regexp_matches(lower(token), '^({'|'.join(K.MEDICAL_PREFIXES)})')
           OR regexp_matches(lower(token), '({'|'.join(K.MEDICAL_SUFFIXES)})$'))""")
def vocab_abbrev_filter(spark, d):
    tokens = I.token_table(spark, d, T.norm_tokens)
    return tokens.where(V.is_medical_abbreviation(F.col("token"), F.col("zipf"))).select("token", "n")


@query("vocab_stop_candidates", rf"""
    WITH c AS (SELECT t AS cased, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[{S.W}]+')) AS t FROM documents) GROUP BY t)
    SELECT token_source, n AS count, cased AS match
    FROM (SELECT lower(cased) AS token_source, n, cased, row_number() OVER (PARTITION BY lower(cased) ORDER BY n DESC, cased) AS r FROM c) WHERE r = 1""")
def vocab_stop_candidates(spark, d):
    cased = V.vocab_count(table(spark, d, "documents"), T.plain_words(F.col("text")), "match", "count")
    rows = cased.withColumn("token_source", F.lower("match"))
    return V.top_suggestion_per_token(rows, "token_source", "count", ["match"]).orderBy(F.desc("count"), "token_source")


@query("lexicon_build", f"""
    SELECT DISTINCT unnest({S.tokens('p_name')}) AS word FROM part UNION SELECT DISTINCT unnest({S.tokens('p_type')}) FROM part
    UNION SELECT DISTINCT unnest({S.tokens('p_brand')}) FROM part""")
def lexicon_build(spark, d):
    part = table(spark, d, "part")
    return V.lexicon_from_columns([(part, "p_name"), (part, "p_type"), (part, "p_brand")])


@query("word_grep", f"""
    SELECT doc_id, list_contains({S.tokens('text')}, 'eau') AS whole_word FROM documents WHERE contains(lower(text), 'eau')""")
def word_grep(spark, d):
    hits = table(spark, d, "documents").where(F.lower("text").contains("eau"))
    return hits.select("doc_id", F.array_contains(T.norm_tokens(F.col("text")), "eau").alias("whole_word"))


@query("tok_index_pad", f"""
    WITH n AS (SELECT conv_id, turn, {S.tokens('text')} AS ts FROM conversations),
    v AS (SELECT t, count(*) AS c FROM (SELECT unnest(ts) AS t FROM n) GROUP BY t),
    idx AS (SELECT t, row_number() OVER (ORDER BY c DESC, t) + 1 AS id FROM v QUALIFY row_number() OVER (ORDER BY c DESC, t) <= 1998),
    e AS (SELECT conv_id, turn, u.t, u.p FROM n, unnest(ts) WITH ORDINALITY AS u(t, p)),
    s AS (SELECT conv_id, turn, list(coalesce(id, 1) ORDER BY p) AS ids FROM e LEFT JOIN idx USING (t) GROUP BY ALL)
    SELECT conv_id, turn, array_to_string(list_concat(list_transform(range((SELECT max(len(ts)) FROM n) - coalesce(len(ids), 0)), lambda i: 0), coalesce(ids, [])), ' ') AS ids
    FROM n LEFT JOIN s USING (conv_id, turn)""")
def tok_index_pad(spark, d):
    notes = table(spark, d, "conversations")
    tokens = T.norm_tokens(F.col("text"))
    index = V.token_index(V.vocab_count(notes, tokens), 2000)
    padded = V.index_and_pad(notes, ["conv_id", "turn"], tokens, index)
    return padded.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), " "))


def sug(name, select, extra=""):
    """SQL of one suggestion family over the token table."""
    return f"WITH {I.sql_token_table()}{extra} {select}"


def family_select(category, match="''", score=0.0, dist=0, expansions="''", source="tok", where="true"):
    return (f"SELECT token AS token_source, {match} AS match, n AS count, {score}::DOUBLE AS score, {dist}::INT AS edit_dist, "
            f"'{category}' AS category, {expansions} AS expansions FROM {source} WHERE {where}")


FIX = "status <> 'valid'"
ACCENTS = f"""
    accents AS MATERIALIZED (SELECT strip_accents(w) AS k, min(w) AS accented FROM (SELECT DISTINCT lower(token) AS w FROM tok WHERE status = 'valid')
                WHERE NOT {S.is_function_word('w')} GROUP BY 1)"""
ADDS = "strip_accents({t}) = {t} AND strip_accents(accented) <> accented AND accented <> {t}"
ALLOWED = f"length(token) > 3 AND NOT {S.is_function_word('token')} AND word_like = 1"
UPPER_TOKEN = r"regexp_matches(token, '^[A-Z0-9][A-Z0-9+\-_/]*$')"
CANDIDATE = rf"""(word_like = 1 AND lower(token) NOT IN {S.words_in(K.ABBREVIATION_STOPWORDS)} AND zipf <= 3.5 AND length(token) <= 6
    AND (token LIKE '%.%' OR (length(regexp_replace(token, '[^\p{{L}}]', '', 'g')) >= 2 AND length(regexp_replace(token, '[^\p{{Lu}}]', '', 'g')) >= 2
         AND NOT regexp_matches(token, '\p{{Ll}}'))))"""
INTENSITY = r"'^([a-zàâçéèêëîïôûùüÿñæœ\-]+)(\+{2,})$'"
ELIGIBLE = r"""(word_like = 1 AND length(token) >= 5 AND NOT regexp_matches(token, '[\p{Nd}\-.''’]')
    AND NOT (regexp_matches(token, '\p{L}') AND regexp_replace(regexp_replace(token, '[^\p{L}]', '', 'g'), '\p{Lu}', '', 'g') = '')
    AND NOT (zipf > 0 AND zipf >= 2.5))"""
TYPO = f"""
    f AS MATERIALIZED (SELECT DISTINCT lower(token) AS w, zipf FROM tok WHERE {FIX} AND {ELIGIBLE}),
    v AS MATERIALIZED (SELECT DISTINCT lower(token) AS w FROM tok WHERE status = 'valid'),
    fd AS MATERIALIZED (SELECT w, i, hash(substr(w, 1, i - 1) || substr(w, i + 1)) AS rest FROM (SELECT DISTINCT w FROM f WHERE length(w) <= (SELECT max(length(w)) + 1 FROM v)), unnest(range(1, length(w) + 1)) AS u(i)),
    vd AS MATERIALIZED (SELECT w, i, hash(substr(w, 1, i - 1) || substr(w, i + 1)) AS rest FROM v, unnest(range(1, length(w) + 1)) AS u(i)),
    near AS (SELECT fd.w, vd.w AS m FROM fd JOIN vd ON fd.i = vd.i AND fd.rest = vd.rest AND fd.w <> vd.w
             UNION SELECT fd.w, v.w FROM fd JOIN v ON fd.rest = hash(v.w) AND length(fd.w) = length(v.w) + 1
             UNION SELECT f.w, vd.w FROM f JOIN vd ON vd.rest = hash(f.w) AND length(vd.w) = length(f.w) + 1),
    best AS MATERIALIZED (SELECT w, min(m) AS m FROM near GROUP BY w),
    typos AS MATERIALIZED (SELECT DISTINCT best.w, m FROM best JOIN f USING (w) LEFT JOIN zipfs ON zipfs.t = m
              WHERE coalesce(z, 0) = 0 OR f.zipf = 0 OR z - f.zipf >= 1.0)"""


@query("sug_manual", sug("", family_select("MANUAL_DICT", "value", 100, source="tok JOIN dict ON key = lower(token)", where=FIX), "," + I.SQL_DICTIONARY))
def sug_manual(spark, d):
    return G.manual(I.token_table(spark, d), I.correction_dictionary(spark, d))


@query("sug_diacritics_strict", sug("", family_select(
    "DIACRITICS_STRICT", "accented", 100, source="tok JOIN accents ON k = strip_accents(lower(token))",
    where=f"{FIX} AND {ALLOWED} AND {ADDS.format(t='lower(token)')}"), "," + ACCENTS))
def sug_diacritics_strict(spark, d):
    return G.diacritics_strict(cut_lineage(I.token_table(spark, d)))


@query("sug_diacritics_multi", sug("", f"""
    , b AS (SELECT a || ' ' || c AS token, a, c, count(*) AS n FROM (
            SELECT strip_accents(ts[i]) AS a, strip_accents(ts[i + 1]) AS c FROM (SELECT {S.tokens('text')} AS ts FROM conversations), unnest(range(1, len(ts))) AS u(i)) GROUP BY a, c),
    m AS (SELECT token, n, a, c, x.accented AS xa, y.accented AS yc,
                 coalesce(NOT {S.is_function_word('a')} AND strip_accents(x.accented) <> x.accented AND x.accented <> a, false) AS ua,
                 coalesce(NOT {S.is_function_word('c')} AND strip_accents(y.accented) <> y.accented AND y.accented <> c, false) AS uc
          FROM b LEFT JOIN accents x ON x.k = a LEFT JOIN accents y ON y.k = c)
    """ + family_select("DIACRITICS_MULTI", "CASE WHEN ua THEN xa ELSE a END || ' ' || CASE WHEN uc THEN yc ELSE c END", 100, source="m", where="ua OR uc"),
    "," + ACCENTS))
def sug_diacritics_multi(spark, d):
    """Pairs of neighbouring words of the conversations, accents removed, restored from the valid words."""
    ts = F.transform(T.norm_tokens(F.col("text")), lambda t: T.unaccent(t))
    notes = table(spark, d, "conversations").select(ts.alias("ts")).where(F.size("ts") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("ts") - 1), lambda i: F.concat(F.get("ts", i - 1), F.lit(" "), F.get("ts", i)))
    return G.diacritics_multi(V.vocab_count(notes, pairs), G.valid_words(I.token_table(spark, d)))


@query("sug_abbrev_sure", sug("", family_select("ABBREV_SURE", "value", 100, source=f"tok JOIN sure ON key = {S.upper('token')}",
                                                where=f"{UPPER_TOKEN} AND {S.upper('token')} NOT IN (SELECT key FROM amb)"), "," + I.SQL_ABBREVIATIONS))
def sug_abbrev_sure(spark, d):
    return G.abbrev_sure(I.token_table(spark, d), *I.abbreviations(spark, d))


@query("sug_abbrev_ambiguous", sug("", family_select("ABBREV_AMBIGU", expansions="array_to_string(expansions, ' | ')", source=f"tok JOIN amb ON key = {S.upper('token')}"),
                                   "," + I.SQL_ABBREVIATIONS))
def sug_abbrev_ambiguous(spark, d):
    return G.abbrev_ambiguous(I.token_table(spark, d), I.abbreviations(spark, d)[1])


@query("sug_abbrev_candidate", sug("", family_select(
    "ABBREV_CANDIDATE", where=f"{CANDIDATE} AND {S.upper('token')} NOT IN (SELECT key FROM sure UNION SELECT key FROM amb)"), "," + I.SQL_ABBREVIATIONS))
def sug_abbrev_candidate(spark, d):
    return G.abbrev_candidate(I.token_table(spark, d), *I.abbreviations(spark, d))


@query("sug_intensity", rf"""
    WITH t AS (SELECT unnest(list_filter(string_split(trim(regexp_replace(text, '{S.SP}+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM documents),
    tok AS (SELECT CASE WHEN length(t) % 5 = 0 THEN t || '+++' ELSE t END AS token, count(*) AS n FROM t GROUP BY 1)
    """ + family_select("INTENSITY", f"regexp_replace(lower(token), {INTENSITY}, '\\1 (\\2)')", 100, where=f"regexp_matches(lower(token), {INTENSITY})"))
def sug_intensity(spark, d):
    """Vocabulary in which every token of five letters (or ten, ...) carries three plus signs."""
    marked = F.transform(I.raw_tokens(F.col("text")), lambda t: F.when(F.length(t) % 5 == 0, F.concat(t, F.lit("+++"))).otherwise(t))
    return G.intensity(V.vocab_count(table(spark, d, "documents"), marked).withColumn("status", F.lit("invalid")))


@query("sug_typo", sug("", family_select("TYPO", "m", 90, 1, source="tok JOIN typos ON w = lower(token)", where=f"{FIX} AND {ELIGIBLE}"), "," + TYPO))
def sug_typo(spark, d):
    return G.typo(cut_lineage(I.token_table(spark, d)))


@query("sug_enrich", sug("", family_select("ENRICH_METIER", where=f"{FIX} AND word_like = 1 AND zipf <= 1.5")))
def sug_enrich(spark, d):
    return G.enrich(I.token_table(spark, d))


SQL_ALL = sug("", f""",
    j AS (SELECT token, n, status, zipf, word_like, dict.value AS dv, accented, sure.value AS sv, amb.expansions AS mv, typos.m AS tv
          FROM tok LEFT JOIN dict ON dict.key = lower(token) LEFT JOIN accents ON accents.k = strip_accents(lower(token))
          LEFT JOIN sure ON sure.key = {S.upper('token')} LEFT JOIN amb ON amb.key = {S.upper('token')} LEFT JOIN typos ON typos.w = lower(token)),
    c AS (SELECT *, CASE WHEN {FIX} AND dv IS NOT NULL THEN 'MANUAL_DICT'
            WHEN {FIX} AND {ALLOWED} AND {ADDS.format(t='lower(token)')} THEN 'DIACRITICS_STRICT' WHEN mv IS NOT NULL THEN 'ABBREV_AMBIGU'
            WHEN sv IS NOT NULL AND {UPPER_TOKEN} THEN 'ABBREV_SURE' WHEN {CANDIDATE} THEN 'ABBREV_CANDIDATE'
            WHEN {FIX} AND regexp_matches(lower(token), {INTENSITY}) THEN 'INTENSITY' WHEN {FIX} AND {ELIGIBLE} AND tv IS NOT NULL THEN 'TYPO'
            WHEN {FIX} AND word_like = 1 AND zipf <= 1.5 THEN 'ENRICH_METIER' WHEN {FIX} THEN 'REJECTED' END AS category FROM j),
    allsug AS (SELECT token AS token_source, CASE category WHEN 'MANUAL_DICT' THEN dv WHEN 'DIACRITICS_STRICT' THEN accented WHEN 'ABBREV_SURE' THEN sv
               WHEN 'INTENSITY' THEN regexp_replace(lower(token), {INTENSITY}, '\\1 (\\2)') WHEN 'TYPO' THEN tv ELSE '' END AS match, n AS count,
               CASE WHEN category IN ('MANUAL_DICT', 'DIACRITICS_STRICT', 'ABBREV_SURE', 'INTENSITY') THEN 100.0 WHEN category = 'TYPO' THEN 90.0 ELSE 0.0 END::DOUBLE AS score,
               CASE category WHEN 'TYPO' THEN 1 ELSE 0 END AS edit_dist, category,
               CASE category WHEN 'ABBREV_AMBIGU' THEN array_to_string(mv, ' | ') ELSE '' END AS expansions FROM c WHERE category IS NOT NULL)
    """, "," + ",".join([I.SQL_DICTIONARY, ACCENTS, I.SQL_ABBREVIATIONS, TYPO]))


def all_suggestions(spark, d):
    """The vocabulary is written once, so the corpus is scanned once however many families look at it."""
    tokens = cut_lineage(I.token_table(spark, d))
    sure, ambiguous = I.abbreviations(spark, d, tokens)
    return G.suggest_all(tokens, I.correction_dictionary(spark, d), sure, ambiguous)


query("sug_all", SQL_ALL + "SELECT * FROM allsug")(all_suggestions)

_STORED: dict[tuple[str, str], str] = {}


def stored_suggestions(spark, d):
    """The suggestions as a written table, made once per application and folder: what works on notes reads it, as a review session does."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        path = work_path(spark, "suggestions")
        all_suggestions(spark, d).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


@query("sug_rejected", SQL_ALL + "SELECT token_source, count FROM allsug WHERE category = 'REJECTED'")
def sug_rejected(spark, d):
    return all_suggestions(spark, d).where(F.col("category") == "REJECTED").select("token_source", "count")


@query("sug_automatic", SQL_ALL + "SELECT token_source, category, CASE category " + " ".join(
    f"WHEN '{k}' THEN '{label}'" for k, (label, _) in K.FAMILIES.items()) + " ELSE category END AS family_label, category IN "
    + S.words_in([k for k, (_, auto) in K.FAMILIES.items() if auto]) + " AND length(match) > 0 AS is_auto FROM allsug")
def sug_automatic(spark, d):
    return G.with_automatic(all_suggestions(spark, d)).select("token_source", "category", "family_label", "is_auto")


# Words in ASCII spelling, since edit distances in SQL count bytes.
ASCII = "replace(replace(replace(replace(strip_accents({}), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'ø', 'o')"


@query("token_nearest_fuzzy", rf"""
    WITH {I.SQL_REFERENCE},
    words AS MATERIALIZED (SELECT DISTINCT {ASCII.format('t')} AS word FROM (SELECT unnest({S.tokens('text')}) AS t FROM conversations)),
    names AS MATERIALIZED (SELECT DISTINCT {ASCII.format('w')} AS lex FROM lex),
    scored AS (SELECT word, lex, round(100.0 * (1 - levenshtein(word, lex)::DOUBLE / greatest(length(word), length(lex))), 2) AS score FROM words, names)
    SELECT word, arg_min(lex, {{'k': -score, 'l': lex}}) AS nearest, max(score) AS score FROM scored GROUP BY word""")
def token_nearest_fuzzy(spark, d):
    """The best lexicon word of every conversation word, accents aside."""
    words = table(spark, d, "conversations").select(F.explode(T.norm_tokens(F.col("text"))).alias("word"))
    return nearest_words(words.select(T.unaccent(F.col("word"), "ascii").alias("word")), I.lexicon(spark, d).select(T.unaccent(F.col("word"), "ascii").alias("lex")))


SQL_SPELL = f"""{I.SQL_REFERENCE},
    words AS (SELECT DISTINCT t AS w FROM (SELECT unnest({S.tokens('text')}) AS t FROM documents) WHERE length(t) > 3 AND t NOT IN (SELECT w FROM lex)),
    good AS (SELECT w FROM lex WHERE length(w) > 3),
    wd AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM words, unnest(range(1, length(w) + 1)) AS u(i)),
    gd AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM good, unnest(range(1, length(w) + 1)) AS u(i)),
    near AS (SELECT wd.w, gd.w AS m FROM wd JOIN gd ON wd.i = gd.i AND wd.rest = gd.rest AND wd.w <> gd.w
             UNION SELECT wd.w, good.w FROM wd JOIN good ON wd.rest = good.w UNION SELECT words.w, gd.w FROM words JOIN gd ON gd.rest = words.w),
    {I.SQL_DICTIONARY.strip()},
    spell AS (SELECT w AS key, min(m) AS value FROM near WHERE w NOT IN (SELECT key FROM dict) GROUP BY w)"""


def spell_dictionary(spark, d):
    """Corrections of unknown words by the first lexicon word one edit away, except words the dictionary already has."""
    known = as_lookup(I.lexicon(spark, d), G.EDIT_LOOKUP_ROWS)
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(T.norm_tokens(F.col("text")))).alias("key")).where(F.length("key") > 3).distinct()
    unknown = words.join(known, F.col("key") == F.col("word"), "left_anti").join(I.correction_dictionary(spark, d), "key", "left_anti")
    unknown = cut_lineage(unknown)  # keys are made of it twice; the documents are read once
    pairs = G.edit1_pairs(unknown, known.where(F.length("word") > 3), "key", "word")
    return pairs.groupBy("key").agg(F.min("word").alias("value"))


query("spell_dict_build", f"WITH {SQL_SPELL} SELECT key, value FROM spell")(spell_dictionary)


@query("consonant_ratio", rf"""
    SELECT DISTINCT t AS token, CASE WHEN NOT regexp_matches(t, '\p{{L}}') THEN 0.0 ELSE
        round(length(regexp_replace(regexp_replace(t, '[^\p{{L}}]', '', 'g'), '[{K.VOWELS}]', '', 'g'))::DOUBLE / length(regexp_replace(t, '[^\p{{L}}]', '', 'g')), 6) END AS ratio
    FROM (SELECT unnest({S.tokens('text')}) AS t FROM documents)""")
def consonant_ratio(spark, d):
    tokens = V.vocab_count(table(spark, d, "documents"), T.norm_tokens(F.col("text"))).select("token")
    return tokens.withColumn("ratio", F.round(T.consonant_ratio(F.col("token")), 6))
