"""Text normalisation and tokenisation queries."""

from pyspark.sql import functions as F

from carnet import constants as K
from carnet.functions import text as T
from carnet.operators import notes
from carnet.plans import sqlparts as S
from carnet.registry import query, table


def per_document(name, fn, sql, result="result"):
    """A query that applies one column function to every document text."""
    query(name, f"SELECT doc_id, {sql} AS {result} FROM documents")(
        lambda spark, d: table(spark, d, "documents").select("doc_id", fn(F.col("text")).alias(result))
    )


per_document("txt_lower_punct", T.lower_punct, S.norm("text"))
per_document("txt_remove_special", T.remove_special,
             "translate(text, '" + K.ASCII_PUNCTUATION.replace("'", "''") + "', '" + " " * len(K.ASCII_PUNCTUATION) + "')")
per_document("txt_unaccent", T.unaccent, "strip_accents(text)")
per_document("txt_lower", F.lower, "lower(text)")
per_document("txt_trim_punct", T.trim_punct, r"regexp_replace(text, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')")
# Documents get separator lines after their line breaks and a short run inside.
DIRTY_SQL = "replace(replace(text, chr(10), chr(10) || ' ===== ' || chr(10) || chr(10)), ' la ', ' ==== ')"


def with_bars(c):
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\n ===== \n\n")), F.lit(" la "), F.lit(" ==== "))


per_document("txt_strip_eq", lambda c: T.strip_separators(with_bars(c)),
             rf"regexp_replace(regexp_replace(regexp_replace({DIRTY_SQL}, '(?m)^{S.SP}*={{3,}}{S.SP}*$', '', 'g'), "
             r"'={3,}', ' ', 'g'), '[ \t]{2,}', ' ', 'g')")
per_document("txt_time_units",
             lambda c: T.time_units(T.unaccent(c)),
             r"regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '(?i)\b(\d+)\s*/\s*j\b', '\1 / jour', 'g'), "
             r"'(?i)\b(q{1,2}u?e?l?q?u?e?s?|qqs?|qques)\s*j\b', 'quelques jours', 'g'), '(?i)\b(\d+)\s*j\b', '\1 jours', 'g')")
per_document("txt_shorten", lambda c: T.shorten(c, 200),
             "CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END")


@query("txt_tokens_space", f"""
    SELECT doc_id, CAST(p AS INT) - 1 AS pos, t AS token
    FROM (SELECT doc_id, {S.tokens('text')} AS ts FROM documents), unnest(ts) WITH ORDINALITY AS u(t, p)""")
def txt_tokens_space(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.norm_tokens(F.col("text"))).alias("pos", "token"))


@query("txt_has_diacritics", f"""
    SELECT DISTINCT t AS token, t <> strip_accents(t) AS accented
    FROM (SELECT unnest({S.tokens('text')}) AS t FROM documents)""")
def txt_has_diacritics(spark, d):
    tokens = notes.explode_tokens(table(spark, d, "documents"), "text").select("token").distinct()
    return tokens.withColumn("accented", T.has_diacritics(F.col("token")))


@query("txt_words", rf"""
    SELECT doc_id, CAST(p AS INT) - 1 AS pos, t AS word
    FROM (SELECT doc_id, regexp_extract_all(text, '[{S.W}'']+') AS ts FROM documents), unnest(ts) WITH ORDINALITY AS u(t, p)""")
def txt_words(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))


@query("txt_encoding_repair", r"""
    SELECT doc_id, replace(regexp_replace(translate(dirty, chr(146) || chr(160), ''' '), '[' || chr(140) || chr(156) || ']', 'oe', 'g'),
                           chr(133), '') AS repaired
    FROM (SELECT doc_id, replace(replace(replace(replace(text, '''', chr(146)), 'ou', chr(156)), '. ', chr(133) || chr(160)), 'Ou', chr(140)) AS dirty
          FROM documents)""")
def txt_encoding_repair(spark, d):
    """Documents are first damaged the way the source files are, then repaired."""
    dirty = F.col("text")
    for found, stray in (("'", "\x92"), ("ou", "\x9c"), (". ", "\x85\xa0"), ("Ou", "\x8c")):
        dirty = F.replace(dirty, F.lit(found), F.lit(stray))
    return table(spark, d, "documents").select("doc_id", T.encoding_repair(dirty).alias("repaired"))


QUESTION_RULES = " ".join("WHEN regexp_matches(bare, '" + p.replace("'", "''") + "') THEN '" + w.replace("'", "''") + "'" for p, w in notes.QUESTION_WORDS)


@query("txt_question_repair", rf"""
    WITH t AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest(list_filter(string_split(trim(regexp_replace(replace(replace(text, 'ti', '?'), '''', '?'), '{S.SP}+', ' ', 'g')), ' '),
               lambda x: x <> '')) AS t FROM documents) GROUP BY t),
    b AS (SELECT token, n, regexp_replace(token, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS bare FROM t),
    s AS (SELECT *, regexp_extract(bare, '(?i)^([{S.W}'']{{2,}})c\?lio[a-z]*', 1) AS scope, regexp_extract(bare, '^([{S.W}'']*)\?', 1) AS before FROM b),
    r AS (SELECT token, n, CASE WHEN NOT regexp_matches(token, '[\p{{L}}\p{{N}}]') THEN token WHEN regexp_matches(token, '(?i)\?stradiol') THEN 'estradiol' WHEN NOT contains(bare, '?') THEN bare
          WHEN scope <> '' THEN scope || ' coelioscopie' {QUESTION_RULES} WHEN regexp_matches(bare, '(?i)qu\?') OR length(before) = 1 THEN replace(bare, '?', '''')
          WHEN before = '' THEN replace(bare, '?', '') ELSE replace(bare, '?', 'ti') END AS repaired FROM s)
    SELECT *, repaired <> token AS changed FROM r""")
def txt_question_repair(spark, d):
    """Damaged words of all documents: distinct tokens are repaired once, with their number of occurrences."""
    docs = table(spark, d, "documents").select("doc_id", F.replace(F.replace(F.col("text"), F.lit("ti"), F.lit("?")),
                                                                 F.lit("'"), F.lit("?")).alias("text"))
    return notes.repair_question_marks(docs, "text")


@query("txt_sentences", f"""
    SELECT doc_id, CAST(p AS INT) - 1 AS pos, sentence FROM (SELECT doc_id, {S.sentences('text')} AS ss FROM documents), unnest(ss) WITH ORDINALITY AS u(sentence, p)""")
def txt_sentences(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("txt_join_sentences", rf"""
    SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)),
               lambda s: {S.strip('s')}), lambda s: s <> ''),
               lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END), ' ') AS joined
    FROM documents""")
def txt_join_sentences(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.join_sentences(F.split(F.col("text"), "\n")).alias("joined"))


@query("txt_sentence_patch", rf"""
    WITH s AS (
        SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS orig
        FROM documents),
    e AS (SELECT doc_id, text, orig, orig[1:2] AS saved, CAST(doc_id % 4 AS INT) AS idx FROM s),
    p AS (SELECT doc_id, idx, list_concat(saved, orig[len(saved) + 1:]) AS base FROM e),
    r AS (SELECT doc_id, list_transform(base, lambda x, i: CASE WHEN i = idx + 1 THEN 'Edit ' || doc_id WHEN i = 1 AND doc_id % 2 = 1 THEN 'First ' || doc_id ELSE x END) AS parts
          FROM p WHERE idx < len(base) OR (doc_id % 2 = 1 AND len(base) > 0))
    SELECT doc_id, array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END), ' ') AS patched
    FROM r""")
def txt_sentence_patch(spark, d):
    """Each document's saved text keeps two lines; line ``doc_id % 4`` is edited, in every other document the first line too; missing lines
    come from the original."""
    lines = T.drop_empty(F.transform(F.split(F.col("text"), "\n"), T.strip_space))
    docs = table(spark, d, "documents").select("doc_id", lines.alias("original"), F.slice(lines, 1, 2).alias("saved"))
    edits = docs.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("idx"),
                        F.concat(F.lit("Edit "), F.col("doc_id").cast("string")).alias("sentence"))
    more = docs.where(F.col("doc_id") % 2 == 1).select("doc_id", F.lit(0).alias("idx"), F.concat(F.lit("First "), F.col("doc_id").cast("string")).alias("sentence"))
    edits = edits.unionByName(more)
    return notes.patch_sentences(docs, edits, "doc_id", "saved", "original")


@query("txt_strip_label", rf"""
    SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN ' APRÈS ' || chr(10) || chr(10) || text ELSE text END,
                                  '(?i)^{S.SP}*après{S.SP}*\r?\n(\r?\n)?', '') AS result
    FROM documents""")
def txt_strip_label(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" APRÈS \n\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.strip_leading_label(text).alias("result"))


@query("txt_word_count", "SELECT len(string_split(text, ' ')) AS n_words, count(*) AS n_texts FROM documents GROUP BY 1")
def txt_word_count(spark, d):
    docs = table(spark, d, "documents")
    counted = docs.groupBy(F.size(F.split(F.col("text"), " ")).cast("long").alias("n_words"))
    return counted.agg(F.count("*").alias("n_texts"))


@query("txt_drop_numbers", rf"""
    SELECT doc_id, array_to_string(list_filter({S.tokens('text')}, lambda t: NOT regexp_matches(t, '\p{{Nd}}')), ' ') AS result
    FROM documents""")
def txt_drop_numbers(spark, d):
    kept = T.drop_number_tokens(T.norm_tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, " ").alias("result"))


@query("txt_stopwords", f"""
    SELECT doc_id, array_to_string(list_filter({S.tokens('text')}, lambda t: t NOT IN {S.STOPWORDS}), ' ') AS result
    FROM documents""")
def txt_stopwords(spark, d):
    kept = T.drop_stopwords(T.norm_tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, " ").alias("result"))


@query("txt_concat_by_id", """
    SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def txt_concat_by_id(spark, d):
    notes_df = table(spark, d, "conversations")
    return notes.concat_by_id(notes_df, "conv_id", "turn", "text")


@query("txt_concat_columns", """
    SELECT conv_id, string_agg(concat_ws(' ', nullif(trim(role), ''), nullif(trim(text), '')), ' ' ORDER BY turn) AS text
    FROM conversations GROUP BY 1""")
def txt_concat_columns(spark, d):
    notes_df = table(spark, d, "conversations")
    joined = notes.join_text_columns(notes_df, ["role", "text"])
    return notes.concat_by_id(joined, "conv_id", "turn", "joined", alias="text")


@query("txt_text_columns", """
    SELECT 'text' AS column_name, bool_or(trim(text) <> '') AS is_text FROM conversations
    UNION ALL SELECT 'role', bool_or(trim(role) <> '') FROM conversations
    UNION ALL SELECT 'conv_id', false UNION ALL SELECT 'turn', false""")
def txt_text_columns(spark, d):
    return notes.text_columns(table(spark, d, "conversations"))


@query("txt_intensity", rf"""
    WITH t AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '{S.SP}+', ' ', 'g'), ' '), lambda x: x <> '')) AS tok FROM documents),
    m AS (SELECT CASE WHEN length(tok) % 3 = 0 THEN tok || repeat('+', 2 + length(tok) % 2) ELSE tok END AS tok FROM t)
    SELECT tok AS token, regexp_replace(tok, '^([a-zàâçéèêëîïôûùüÿñæœ\-]+)(\+{{2,}})$', '\1 (\2)') AS match, count(*) AS n
    FROM m WHERE regexp_matches(tok, '^([a-zàâçéèêëîïôûùüÿñæœ\-]+)(\+{{2,}})$') GROUP BY tok""")
def txt_intensity(spark, d):
    """Blank-separated tokens, a third of them marked with plus signs, counted before the rule is applied."""
    token = F.explode(T.space_tokens(T.squeeze(F.lower(F.col("text"))))).alias("tok")
    marked = F.when(F.length("tok") % 3 == 0, F.concat("tok", F.repeat(F.lit("+"), 2 + F.length("tok") % 2))).otherwise(F.col("tok"))
    counted = table(spark, d, "documents").select(token).groupBy(marked.alias("token")).agg(F.count("*").alias("n"))
    return counted.withColumn("match", T.intensity_token(F.col("token"))).where(F.col("match").isNotNull())


@query("pii_mail_scrub", rf"""
    WITH m AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '[{S.W}.*\-]*@[{S.W}]*[.][{S.W}]*')) AS mails FROM documents),
    l AS (SELECT *, list_transform(mails, lambda x: split_part(x, '@', 1)) AS loc FROM m),
    b AS (SELECT *, list_transform(loc, lambda x: regexp_replace(x, '[0-9]', '', 'g')) AS bare FROM l),
    p AS (SELECT *, flatten(list_transform(bare, lambda x: regexp_split_to_array(x, '[._]'))) AS pieces FROM b),
    o AS (SELECT doc_id, text, mails, list_filter(list_distinct(list_concat(mails, loc, bare, pieces)), lambda x: length(x) >= 2) AS found FROM p),
    s AS (SELECT doc_id, text, mails, list_transform(list_sort(list_transform(found, lambda x: {{'k': -length(x), 'n': x}})), lambda z: z.n) AS names FROM o)
    SELECT doc_id, CASE WHEN len(mails) = 0 THEN text ELSE list_reduce(list_prepend(text, names), lambda a, n: replace(a, n, '')) END AS scrubbed,
           len(mails) AS n_mails
    FROM s""")
def pii_mail_scrub(spark, d):
    docs = table(spark, d, "documents")
    mails = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(T.MAIL), F.lit(0)))
    return docs.select("doc_id", T.scrub_mails(F.col("text")).alias("scrubbed"), F.size(mails).cast("long").alias("n_mails"))


@query("digits_in_names", r"""
    SELECT doc_id, any_digit, array_to_string(list_transform(mails, lambda x: regexp_replace(x, '[0-9]', '', 'g')), ' ') AS without_digits
    FROM (SELECT doc_id, mails, len(list_filter(mails, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS any_digit
          FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9._-]+') AS mails FROM documents))""")
def digits_in_names(spark, d):
    names = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z0-9._-]+@[A-Za-z0-9._-]+"), F.lit(0))
    return table(spark, d, "documents").select(
        "doc_id", F.exists(names, lambda n: n.rlike("[0-9]")).alias("any_digit"),
        F.array_join(F.transform(names, lambda n: F.regexp_replace(n, "[0-9]", "")), " ").alias("without_digits"))
