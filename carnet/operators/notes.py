"""Operators on note tables: tokens, per-patient texts, sentence edits, damaged words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from carnet.functions import text as T


def explode_tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per token of the normalised text."""
    return df.select(*keep, F.explode(T.norm_tokens(F.col(text))).alias("token"))


def ordered_join(value: str, order: list[str], sep: str = " ") -> Column:
    """Aggregate: values joined in the given order, never in arrival order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return F.array_join(F.transform(packed, lambda s: s["__v"]), sep)


def concat_by_id(df: DataFrame, key: str, order: str, text: str, alias: str | None = None, sep: str = " ") -> DataFrame:
    """One text per patient in note order, whatever the number of notes. A text is one cell, so a patient's notes together have to
    fit in one (2 GB); statistics on words count (patient, token) rows instead and need no such text."""
    return df.select(key, order, text).groupBy(key).agg(ordered_join(text, [order], sep).alias(alias or text))


def join_text_columns(df: DataFrame, columns: list[str], alias: str = "joined") -> DataFrame:
    """Non-blank text cells of a row joined with spaces."""
    cells = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in columns]
    return df.withColumn(alias, F.concat_ws(" ", *cells))


def text_columns(df: DataFrame) -> DataFrame:
    """Which columns hold text: string type and at least one non-blank cell, found in one pass."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, TY.StringType)}
    found = [F.coalesce(F.bool_or(F.trim(F.col(c)) != ""), F.lit(False)).alias(c) if c in strings
             else F.first(F.lit(False)).alias(c) for c in df.columns]
    row = df.agg(*found)
    return row.unpivot([], row.columns, "column_name", "is_text")


def patch_sentences(saved: DataFrame, edits: DataFrame, key: str, parts: str, original: str) -> DataFrame:
    """Replace the sentences ``idx`` of the saved sentences, all edits of a document together, one row per document; a shorter saved
    list is padded from the original. Of several edits of one sentence the last in code-point order counts. Edits past the end are
    refused, and a document with no other edit has no row."""
    padded = F.concat(F.col(parts), F.slice(F.col(original), F.size(parts) + 1, F.greatest(F.size(original) - F.size(parts), F.lit(0))))
    changes = edits.where(F.col("idx") >= 0).groupBy(key, "idx").agg(F.max("sentence").alias("sentence"))
    changes = changes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "sentence"))).alias("__edits"))
    joined = saved.join(changes, key).withColumn("__base", padded).where(F.array_min(F.map_keys("__edits")) < F.size("__base"))
    patched = F.transform("__base", lambda s, i: F.coalesce(F.try_element_at("__edits", i), s))
    return joined.select(key, T.join_sentences(patched).alias("patched"))


# Words whose damaged form is recognised, with the repaired word.
QUESTION_WORDS = (
    (r"(?i)^c\?lio", "coelioscopie"),
    (r"(?i)^s\?ur", "soeur"),
    (r"(?i)^a\?ei", "atteinte"),
    (r"(?i)^c\?est", "c'est"),
    (r"(?i)^c\?était", "c'était"),
    (r"(?i)man\?uvr", "manoeuvre"),
    (r"(?i)àl\?IRM", "à l'IRM"),
    (r"(?i)op\?mize\?e", "optimizette"),
    (r"(?i)d'a\?einte", "d'atteinte"),
)


def question_repair(token: Column) -> Column:
    """Repair one token in which '?' replaced a ligature, an apostrophe or 'ti'."""
    bare = T.trim_punct(token)
    joined_scope = F.regexp_extract(bare, rf"(?i)^([{T.WORD}']{{2,}})c\?lio[a-z]*", 1)
    before = F.regexp_extract(bare, rf"^([{T.WORD}']*)\?", 1)
    rule = F.when(joined_scope != "", F.concat(joined_scope, F.lit(" coelioscopie")))
    for pattern, word in QUESTION_WORDS:
        rule = rule.when(bare.rlike(pattern), F.lit(word))
    rule = rule.when(bare.rlike(r"(?i)qu\?"), F.replace(bare, F.lit("?"), F.lit("'")))
    rule = rule.when(F.length(before) == 1, F.replace(bare, F.lit("?"), F.lit("'")))
    rule = rule.when(F.length(before) == 0, F.replace(bare, F.lit("?"), F.lit("")))
    rule = rule.otherwise(F.replace(bare, F.lit("?"), F.lit("ti")))
    return F.when(token.rlike(r"(?i)\?stradiol"), "estradiol").when(bare.contains("?"), rule).otherwise(bare)


def repair_question_marks(df: DataFrame, text: str) -> DataFrame:
    """Distinct blank-separated tokens with their repaired form, kind and number of occurrences."""
    tokens = df.select(F.explode(T.space_tokens(T.squeeze(F.col(text)))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    only_punct = ~F.col("token").rlike(r"[\p{L}\p{N}]")
    repaired = counted.withColumn("repaired", F.when(only_punct, F.col("token")).otherwise(question_repair(F.col("token"))))
    return repaired.withColumn("changed", F.col("repaired") != F.col("token"))
