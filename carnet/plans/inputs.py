"""Inputs shared by several queries, each with the SQL text that builds the same rows on the oracle side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnet.functions import text as T
from carnet.lookups import as_lookup
from carnet.operators import vocab as V
from carnet.plans import sqlparts as S
from carnet.registry import table


def raw_tokens(c):
    """Blank-separated tokens in their original case."""
    return T.drop_empty(F.split(c, rf"{T.SPACE}+"))


def reference_counts(spark, d) -> DataFrame:
    """Token counts of the zipf reference corpus."""
    return V.vocab_count(table(spark, d, "conversations"), T.norm_tokens(F.col("text")))


def lexicon(spark, d) -> DataFrame:
    """Known words: the distinct words of the benchmark passages."""
    return table(spark, d, "benchmark").select(F.explode(T.norm_tokens(F.col("text"))).alias("word")).distinct()


def token_table(spark, d, tokens=raw_tokens) -> DataFrame:
    """Document vocabulary with count, zipf, word_like and status."""
    counted = V.vocab_count(table(spark, d, "documents"), tokens(F.col("text")))
    return V.with_validity(V.with_zipf(counted, reference_counts(spark, d)), lexicon(spark, d))


SQL_REFERENCE = f"""
    ref AS MATERIALIZED (SELECT t, count(*) AS c FROM (SELECT unnest({S.tokens('text')}) AS t FROM conversations) GROUP BY t),
    zipfs AS MATERIALIZED (SELECT t, round(log10(c * 1e9 / (SELECT sum(c)::DOUBLE FROM ref)), 2) AS z FROM ref),
    lex AS MATERIALIZED (SELECT DISTINCT unnest({S.tokens('text')}) AS w FROM benchmark)"""


def sql_token_table(source: str = f"list_filter(string_split(trim(regexp_replace(text, '{S.SP}+', ' ', 'g')), ' '), lambda t: t <> '')") -> str:
    """CTEs ending in ``tok`` (token, n, zipf, word_like, status)."""
    return SQL_REFERENCE + rf""",
    counted AS MATERIALIZED (SELECT t AS token, count(*) AS n FROM (SELECT unnest({source}) AS t FROM documents) GROUP BY t),
    marked AS (SELECT token, n, coalesce(z, 0.0) AS zipf, strip_accents(lower(token)) AS k,
                      CAST(regexp_matches(token, '^[{S.LET}][{S.LET}''\-]*$') AS INT) AS word_like, w IS NOT NULL AS in_lex,
                      bool_or(token <> strip_accents(token)) OVER (PARTITION BY strip_accents(lower(token))) AS twin
               FROM counted LEFT JOIN zipfs ON zipfs.t = lower(token) LEFT JOIN lex ON lex.w = lower(token)),
    tok AS MATERIALIZED (SELECT token, n, zipf, word_like,
                   CASE WHEN {S.is_function_word('token')} THEN 'valid' WHEN word_like = 0 THEN 'invalid'
                        WHEN k <> '' AND twin AND token = strip_accents(token) THEN 'to_fix'
                        WHEN in_lex OR zipf >= 2.5 THEN 'valid' ELSE 'invalid' END AS status
            FROM marked)"""


def correction_dictionary(spark, d) -> DataFrame:
    """Single-word dictionary (key, value): benchmark words of six letters or more, keyed by the word cut short."""
    words = lexicon(spark, d).where(F.length("word") >= 6)
    keyed = words.select(F.expr("left(word, length(word) - 1)").alias("key"), F.col("word").alias("value"))
    return keyed.groupBy("key").agg(F.min("value").alias("value"))


SQL_DICTIONARY = """
    dict AS (SELECT left(w, length(w) - 1) AS key, min(w) AS value FROM lex WHERE length(w) >= 6 GROUP BY 1)"""


def phrase_dictionary(spark, d) -> DataFrame:
    """Phrase dictionary (key, value): the first two words of each benchmark passage."""
    ts = T.norm_tokens(F.col("text"))
    firsts = table(spark, d, "benchmark").where(F.size(ts) >= 2).select(F.array_join(F.slice(ts, 1, 2), " ").alias("key")).distinct()
    return firsts.withColumn("value", F.concat(F.lit("<"), F.upper("key"), F.lit(">")))


SQL_PHRASES = f"""
    phrases AS (SELECT DISTINCT array_to_string(ts[1:2], ' ') AS key, '<' || {S.upper("array_to_string(ts[1:2], ' ')")} || '>' AS value
                FROM (SELECT {S.tokens('text')} AS ts FROM benchmark) WHERE len(ts) >= 2)"""


def acronyms(notes: DataFrame, text: str = "text") -> DataFrame:
    """Capital words of two to six letters; filtered inside each note before they are compared between notes."""
    words = F.filter(F.array_distinct(T.plain_words(F.col(text))), lambda w: w.rlike("^[A-Z]{2,6}$"))
    return notes.select(F.explode(words).alias("key")).distinct()


def abbreviations(spark, d, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sure abbreviations (acronyms of even length, one expansion) and ambiguous ones (odd length, two expansions).
    The acronyms are written once, so the documents are scanned once for both; a stored ``vocabulary`` of blank-separated tokens holds the same
    ones, as no word goes beyond a token, and is read in their place."""
    found = as_lookup(acronyms(table(spark, d, "documents")) if vocabulary is None else acronyms(vocabulary, "token"))
    low = F.lower("key")
    sure = found.where(F.length("key") % 2 == 0).withColumn("value", F.concat(F.lit("long form of "), low))
    two = F.array(F.concat(F.lit("first "), low), F.concat(F.lit("second "), low))
    return sure, found.where(F.length("key") % 2 == 1).withColumn("expansions", two)


SQL_ABBREVIATIONS = rf"""
    acr AS (SELECT DISTINCT t AS key FROM (SELECT unnest(regexp_extract_all(text, '[{S.W}]+')) AS t FROM documents)
            WHERE regexp_matches(t, '^[A-Z]{{2,6}}$')),
    sure AS (SELECT key, 'long form of ' || lower(key) AS value FROM acr WHERE length(key) % 2 = 0),
    amb AS (SELECT key, ['first ' || lower(key), 'second ' || lower(key)] AS expansions FROM acr WHERE length(key) % 2 = 1)"""
