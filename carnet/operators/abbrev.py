"""Abbreviation dictionaries: harvest from pages, split and clean expansions, accept keys, merge sources."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet import constants as K
from carnet.functions import text as T

# A numeric or named character reference; the closing semicolon of a number may be missing.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"
NAMED = {name: text for name, text in html.entities.html5.items() if name.endswith(";")}
# Numbers 128 to 159 stand for the characters of the Windows code page, as browsers read them.
WINDOWS = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _literal_map(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _numbered(ref: Column) -> Column:
    """Character of a numeric reference; numbers that are no character give the replacement character."""
    digits = F.regexp_replace(ref, "[&#xX;]", "")
    code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.regexp_replace(digits, "^0+(?=[0-9])", ""))
    number = F.when(F.length(code) <= 7, code.cast("int")).otherwise(-1)
    fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(fine, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(_literal_map(WINDOWS), code), char)


def unescape(c: Column) -> Column:
    """Numeric (decimal, hexadecimal) and named character references to characters, each once; unknown names stay."""
    named = _literal_map(NAMED)
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({REFERENCE})"), F.lit(1)), lambda ref: F.when(ref.startswith("&#"), _numbered(ref)).otherwise(F.coalesce(F.try_element_at(named, F.substring(ref, F.lit(2), F.length(ref))), ref)))
    pieces = F.zip_with(F.split(c, REFERENCE, -1), found, lambda text, char: F.concat(F.coalesce(text, F.lit("")), F.coalesce(char, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def clean_expansion(c: Column) -> Column:
    """Drop references, wiki brackets, templates and [n] marks; squeeze spaces; trim final punctuation."""
    out = F.regexp_replace(unescape(c), r"(?is)<ref[^>]*>.*?</ref>", "")
    out = F.regexp_replace(out, r"\[\[|\]\]", "")
    out = F.regexp_replace(out, r"\{\{.*?\}\}", "")
    out = F.regexp_replace(out, r"\[\s*\d+\s*\]", "")
    return F.regexp_replace(T.squeeze(out), r"[ ,;.]+$", "")


def dedup_ignoring_case(items: Column) -> Column:
    """First occurrence of each item, compared in lower case, in order."""
    lowered = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def split_expansions(c: Column, clean=clean_expansion) -> Column:
    """Expansion list of a raw value: split on , ; / | dashes and the words ou / or."""
    parts = F.split(clean(c), "(?U)" + K.EXPANSION_SEPARATOR)
    return dedup_ignoring_case(T.drop_empty(F.transform(parts, lambda p: clean(p))))


def split_raw(c: Column) -> Column:
    """The same on dictionary values: only entities and [n] marks are cleaned."""
    tidy = lambda x: T.strip_space(F.regexp_replace(unescape(x), r"\[\s*\d+\s*\]", ""))
    return split_expansions(c, tidy)


def normalize_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(unescape(c), rf"{T.SPACE}+", ""))


def harvest(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """Abbreviations from the ``KEY : expansion`` list items of pages: key, expansions, kind (sure or ambiguous).
    A key found on several items keeps the expansions of the last one, as when entries overwrite each other."""
    items = pages.select(page_id, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<li>(.*?)</li>"), F.lit(1))).alias("pos", "item"))
    plain = items.select(page_id, "pos", T.squeeze(unescape(F.regexp_replace("item", r"<[^>]*>", ""))).alias("line"))
    split = plain.where(F.col("line").rlike(r"^[^:]+:.*\S")).select(
        page_id, "pos", normalize_key(F.regexp_extract("line", r"^([^:]+?)\s*:", 1)).alias("key"),
        split_expansions(F.regexp_extract("line", r"^[^:]+:\s*(.+)$", 1)).alias("expansions"))
    kept = split.where((F.length("key") > 0) & (F.length("key") <= 20) & (F.size("expansions") > 0))
    last = kept.groupBy("key").agg(F.max_by("expansions", F.struct(page_id, "pos")).alias("expansions"))
    sure = (F.size("expansions") == 1) & ~F.col("key").isin(*K.SURE_KEY_BLACKLIST)
    return last.withColumn("kind", F.when(sure, "sure").otherwise("ambiguous"))


def with_defaults(sure: DataFrame, ambiguous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Given dictionaries with the default abbreviations added; given entries win, of both kinds."""
    spark = sure.sparkSession
    known = sure.select("key").unionByName(ambiguous.select("key")).distinct()
    more_sure = spark.createDataFrame(list(K.DEFAULT_SURE_ABBREVIATIONS.items()), "key string, value string").join(known, "key", "left_anti")
    more_unclear = spark.createDataFrame(list(K.DEFAULT_AMBIGUOUS_ABBREVIATIONS.items()), "key string, expansions array<string>").join(known, "key", "left_anti")
    return sure.select("key", "value").unionByName(more_sure), ambiguous.select("key", "expansions").unionByName(more_unclear)


def merge(local_sure: DataFrame, found_sure: DataFrame, local_amb: DataFrame, found_amb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local entries win; black-listed keys are never sure; a sure key is not ambiguous."""
    sure = local_sure.select("key", F.col("value").alias("l")).join(found_sure.select("key", F.col("value").alias("r")), "key", "full")
    sure = sure.where(~F.col("key").isin(*K.SURE_KEY_BLACKLIST)).select("key", F.coalesce("l", "r").alias("value"))
    amb = local_amb.select("key", F.col("expansions").alias("l")).join(found_amb.select("key", F.col("expansions").alias("r")), "key", "full")
    amb = amb.select("key", F.coalesce("l", "r").alias("expansions")).join(sure, "key", "left_anti")
    return sure, amb


def is_blacklisted(c: Column) -> Column:
    return (F.trim(c) == "") | F.lower(F.trim(c)).isin(*sorted({*K.AMBIGUOUS_KEY_BLACKLIST, *K.FUNCTION_WORDS}))


def accept_key(c: Column) -> Column:
    """The key under which an abbreviation is stored, or NULL when it is refused."""
    key = F.trim(c)
    is_lower = key.rlike(r"\p{Ll}") & ~key.rlike(r"\p{Lu}")
    return (F.when(is_blacklisted(key), None)
            .when(is_lower, F.when(key.isin(*K.LOWER_KEY_WHITELIST), key))
            .when(F.upper(key).rlike(K.ACRONYM_PATTERN), F.upper(key)))


def merge_lists(base: DataFrame, other: DataFrame) -> DataFrame:
    """Union of the expansion lists per accepted key, base first, without case-insensitive repeats."""
    b = base.select(accept_key(F.col("key")).alias("key"), F.col("expansions").alias("l")).where(F.col("key").isNotNull())
    o = other.select(accept_key(F.col("key")).alias("key"), F.col("expansions").alias("r")).where(F.col("key").isNotNull())
    none = F.array().cast("array<string>")
    both = b.join(o, "key", "full").select("key", F.concat(F.coalesce("l", none), F.coalesce("r", none)).alias("all"))
    items = T.drop_empty(F.transform("all", T.strip_space))
    return both.select("key", dedup_ignoring_case(items).alias("expansions"))
