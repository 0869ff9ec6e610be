"""Corpus correction with dictionaries.

A dictionary within the bounds of ``lookups`` is broadcast, and the text is rewritten where it is read. With a larger one the distinct words of
each note are joined with it, the few hits are gathered per note, and the note is rewritten from its own hits.

Occurrences, spans and replacements of words and phrases come from one pass of an automaton over the note (``automaton``), however many entries there are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet import constants as K
from carnet.functions import text as T
from carnet.lookups import may_broadcast, one_value, small_entries, with_strategy
from carnet.operators import automaton as A
from carnet.session import cut_lineage

# Workers get the functions with the task, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_SPLIT = "[ /,.-]"
#: Text whose tokens are held at once.
PIECE_BYTES = 8 << 20
#: Passes over the notes that cost about as much as joining their words.
PASSES = 2


def hits_per_note(notes: DataFrame, keys: list[str], tokens: Column, dictionary: DataFrame) -> DataFrame:
    """Dictionary entries met in each note as a list ``hits`` of structs (key, value); notes without a hit have no row."""
    distinct = notes.select(*keys, F.explode(F.array_distinct(tokens)).alias("key"))
    found = distinct.join(dictionary.select("key", "value"), "key")
    return found.groupBy(*keys).agg(F.collect_list(F.struct("key", "value")).alias("hits"))


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """A column of texts in slices of about ``most`` bytes."""
    upto = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    first = 0
    while first < len(texts):
        done = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, done + most, side="right")), first + 1)
        yield texts[first:last]
        first = last


def _tokens_replaced(texts: pa.Array, entries: dict[str, str]) -> pa.Array:
    """Texts with the tokens that ``entries`` knows replaced, a space after each token. Each distinct token is looked up once."""
    parts = pc.split_pattern_regex(texts, BATCH_SPLIT)
    coded = parts.flatten().dictionary_encode()
    fixed = pa.array([entries.get(t, t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.fill_null(pc.list_value_length(parts), 0))])
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, fixed), " ")
    return pc.if_else(texts.is_valid(), pc.binary_join_element_wise(joined, "", " "), None)


def replace_by_dictionary(text: Column, entries: Broadcast) -> Column:
    """:func:`_tokens_replaced` by one dictionary for all notes."""

    @F.arrow_udf("string")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.string()), *(_tokens_replaced(t, entries.value) for t in pieces(texts))])

    return compute.asNondeterministic()(text)


def replace_by_hits(text: Column, hits: Column) -> Column:
    """:func:`_tokens_replaced` by each note's own hits, a list of structs (key, value)."""

    @F.arrow_udf("string")
    def compute(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = [pa.array([], pa.string())]
        for nth, held in enumerate(lists):
            mine = {}
            if held.is_valid:
                mine = dict(zip(*(held.values.field(c).to_pylist() for c in ("key", "value"))))
            out.append(_tokens_replaced(texts[nth:nth + 1], mine))
        return pa.concat_arrays(out)

    return compute.asNondeterministic()(text, hits)


def correct_tokens(notes: DataFrame, keys: list[str], text: str, dictionary: DataFrame, alias: str = "corrected") -> DataFrame:
    """Replace tokens found in the dictionary after splitting on blanks, slashes, commas, dots and hyphens.
    As in the original data, every token is followed by a space. A dictionary that may be broadcast is applied where the text is read, so no text moves;
    a larger one goes through the hits of each note. Either way a token is looked up in a hash table, whatever the number of entries or hits."""
    stored = cut_lineage(one_value(dictionary).select("key", "value"))
    entries = small_entries(stored)
    if entries is None and may_broadcast(stored):
        entries = dict(map(tuple, stored.collect()))
    if entries is not None:
        return notes.select(*keys, replace_by_dictionary(F.col(text), notes.sparkSession.sparkContext.broadcast(entries)).alias(alias))
    rows = notes.select(*keys, text)
    found = rows.join(hits_per_note(rows, keys, F.split(F.col(text), BATCH_SPLIT), stored), keys, "left")
    return found.select(*keys, replace_by_hits(F.col(text), F.col("hits")).alias(alias))


def with_patterns(dictionary: DataFrame, ignore_case: bool = True, guard: bool = True) -> DataFrame:
    """The dictionary with what the automaton looks for: a word looked for as written (``ignore_case`` False) may stand before an apostrophe, other entries may not."""
    plain = F.col("key").rlike(rf"^[{T.WORD}]+$")
    return dictionary.withColumn("cased", F.lit(not ignore_case)).withColumn("guard", F.lit(guard) & (F.lit(ignore_case) | ~plain))


def _word_hits(notes: DataFrame, keys: list[str], text: str, patterns: DataFrame) -> DataFrame:
    """Occurrences (keys, key, cased, guard, occ) of patterns of one word by equality with the counted words of each note: one pass over the notes, whatever the
    number of patterns."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"[{T.WORD}]+['’]?"), F.lit(0)))
    forms = notes.select(*keys, found.alias("__form")).groupBy(*keys, "__form").agg(F.count("*").alias("occ"))
    forms = forms.withColumn("__word", F.rtrim("__form", F.lit("'’")))
    met = forms.join(patterns.withColumn("__low", F.lower(F.trim("key"))), F.lower("__word") == F.col("__low"))
    return met.where("NOT (guard AND __form <> __word) AND NOT (cased AND __word <> trim(key))").select(*keys, "key", "cased", "guard", "occ")


def occurrences(notes: DataFrame, keys: list[str], text: str, entries: DataFrame, *carry: str, rows: int = A.SLICE_ROWS) -> DataFrame:
    """Occurrences of each entry (stored; key, value, cased, guard and the columns ``carry``) in each note, from one pass over the notes. Of more entries than
    ``PASSES`` automata take, those of one word are joined with the words of the notes, so that the number of passes does not grow with the words."""
    patterns, words = entries.select("key", "cased", "guard").distinct(), None
    if patterns.count() > PASSES * rows:
        word = F.trim("key").rlike(rf"^[{T.WORD}]+$")
        patterns, words = cut_lineage(patterns.where(~word)), patterns.where(word)
    hits = A.count(notes.select(*keys, text), text, patterns, "__hits", rows).select(*keys, F.explode("__hits").alias("h")).select(*keys, "h.*")
    if words is not None:
        hits = hits.unionByName(_word_hits(notes, keys, text, words))
    hits = hits.groupBy(*keys, "key", "cased", "guard").agg(F.sum("occ").alias("occ"))
    return hits.join(entries.select(*carry, "key", "value", "cased", "guard"), ["key", "cased", "guard"]).select(*keys, *carry, "key", "value", "occ")


def phrase_occurrences(notes: DataFrame, keys: list[str], text: str, phrases: DataFrame, ignore_case: bool = True, *carry: str) -> DataFrame:
    """Occurrences of each phrase of a stored dictionary in each note."""
    return occurrences(notes, keys, text, with_patterns(phrases, ignore_case), *carry)


def apply_corrections(notes: DataFrame, keys: list[str], text: str, suggestions: DataFrame) -> DataFrame:
    """Corrected text of every note; ``suggestions`` has the note keys, key (source) and value (replacement). Longest sources are applied first, each
    to what the earlier ones left, then time units are normalised."""
    pairs = suggestions.where((F.col("key") != "") & (F.col("value") != "")).groupBy(*keys).agg(
        F.collect_set(F.struct(F.col("key").alias("src"), F.col("value").alias("dst"))).alias("pairs"))
    rows = notes.select(*keys, text).join(pairs, keys, "left")
    return rows.select(*keys, T.time_units(A.rewrite(F.col(text), F.col("pairs"))).alias("corrected"))


def annotate_abbreviations(notes: DataFrame, keys: list[str], text: str, choices: DataFrame) -> DataFrame:
    """Write ``TOKEN [expansion]`` after each chosen abbreviation; earlier annotations of these tokens are removed first."""
    picked = choices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("picked"))
    rows = notes.select(*keys, text).join(picked, keys, "left")
    token = lambda p: F.concat(F.lit(r"(?U)\b"), T.quote_regex(p["key"]), F.lit(r"\b"))
    bare = F.aggregate("picked", F.col(text), lambda out, p: F.regexp_replace(
        out, F.concat(token(p), F.lit(r"\s*\[\s*[^]\r\n]*?\s*\]")), T.quote_replacement(p["key"])))
    bare = F.when(F.contains(F.col(text), F.lit("[")), bare).otherwise(F.col(text))
    pairs = F.transform("picked", lambda p: F.struct(p["key"].alias("src"), F.concat(p["key"], F.lit(" ["), p["value"], F.lit("]")).alias("dst")))
    return rows.select(*keys, A.rewrite(bare, pairs, cased=True, guard=False, in_order=True).alias("annotated"))


def match_spans(notes: DataFrame, keys: list[str], text: str, dictionary: DataFrame, guard: bool = False) -> DataFrame:
    """Character spans of the words and phrases of a stored dictionary: start, end (exclusive) and matched text; overlapping ones are all given."""
    entries = with_patterns(dictionary.select("key", "value")).withColumn("guard", F.lit(guard))
    found = A.find(notes.select(*keys, text), text, entries, "__spans").select(*keys, F.explode("__spans").alias("s"))
    return found.select(*keys, "s.start", "s.end", "s.matched", "s.key").join(dictionary.select("key", "value"), "key").select(*keys, "start", "end", "matched", "key", "value")


def family_entries(suggestions: DataFrame) -> DataFrame:
    """What is looked for of each suggestion: abbreviations in capitals as written, all others in any case; an apostrophe may follow only sources with other
    characters than those of words."""
    source = F.trim("token_source")
    cased = F.col("family").isin("ABBREV_SURE", "ABBREV_AMBIGU", "ABBREV_CANDIDATE") & (F.upper(source) == source) & source.rlike(r"\p{L}")
    wordish = source.rlike(rf"\s|^[0-9{T.LETTERS}_\-]+$")
    return suggestions.withColumn("__source", F.struct(source.alias("key"), cased.alias("cased"), wordish.alias("guard")))


def family_spans(notes: DataFrame, keys: list[str], text: str, suggestions: DataFrame) -> DataFrame:
    """Where the suggestions selected for each note (keys, family, token_source, match, is_auto) stand in it: start, end, matched text, family, token_source,
    match, is_auto. Spans do not overlap: the longest source wins, then the left one. Suggestions of one source share its spans, one row each."""
    facts = F.struct("family", "token_source", "match", "is_auto")
    picked = family_entries(suggestions).groupBy(*keys, "__source").agg(F.array_sort(F.collect_set(facts)).alias("facts"))
    picked = picked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__source.key").alias("key"), F.col("__source.cased").alias("cased"), F.col("__source.guard").alias("guard"), "facts"))).alias("picked"))
    rows = notes.select(*keys, text).join(picked, keys)
    sources = F.transform("picked", lambda p: F.struct(p["key"].alias("key"), p["cased"].alias("cased"), p["guard"].alias("guard")))
    spans = rows.select(*keys, "picked", F.explode(A.choose_spans(F.col(text), sources)).alias("s"))
    named = spans.select(*keys, "s.start", "s.end", "s.matched", F.explode(F.get("picked", F.col("s.nth"))["facts"]).alias("f"))
    return named.select(*keys, "start", "end", "matched", "f.*")


def applied_spans(corrected: DataFrame, keys: list[str], text: str, suggestions: DataFrame) -> DataFrame:
    """Where the replacements of applied suggestions stand in the corrected text, settled the same way by the length of the replacement."""
    written = suggestions.where(F.trim("match") != "").select(*keys, F.lit("").alias("family"), F.col("match").alias("token_source"), F.struct("family", "token_source").alias("match"), "is_auto")
    found = family_spans(corrected, keys, text, written)
    return found.select(*keys, "start", "end", "matched", "match.family", "match.token_source", F.col("token_source").alias("match"), "is_auto")


def noise_counts(notes: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Occurrences of missing-value artefacts in each note."""
    noise = F.filter(T.plain_words(F.lower(text)), lambda w: w.isin(*K.NOISE_TOKENS))
    return notes.select(*keys, F.explode(noise).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("occ"))


def ambiguous_forms(ambiguous: DataFrame) -> DataFrame:
    """Written forms of ambiguous abbreviations (key, note, prio, form): capitals first, else title case up to four letters, else a white-listed lower form."""
    forms = ambiguous.select("key", F.array_join("expansions", " / ").alias("note"), F.explode(F.array(
        F.struct(F.lit(1).alias("prio"), F.col("key").alias("form")),
        F.struct(F.lit(2).alias("prio"), F.when(F.length("key") <= 4, F.initcap(F.lower("key"))).alias("form")),
        F.struct(F.lit(3).alias("prio"), F.when(F.lower("key").isin(*K.LOWER_MATCH_WHITELIST), F.lower("key")).alias("form")))).alias("f"))
    return forms.select("key", "note", "f.prio", "f.form").where(F.col("form").isNotNull())


# Families that a list of suggestions can bring along; MANUAL_DICT goes to the dictionary families.
LISTED = ("TYPO", "DIACRITICS_STRICT", "DIACRITICS_MULTI", "ABBREV_CANDIDATE", "EXPERT_NORMALIZATION", "MORPHO_AGREEMENT", "ENRICH_METIER", "ALERTE_SEMANTIQUE", "MANUAL_DICT")


def listed_entries(listed: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """(family, key, value) of listed suggestions (category, token_source, match): sources in lower case, no artefacts, manual entries as
    words or phrases of the dictionary."""
    key = F.lower(F.trim("token_source"))
    several = key.rlike(r"\s")
    family = F.when(F.col("category") == "MANUAL_DICT", F.when(several, "PHRASE_DICT").otherwise("DICT")).otherwise(F.col("category"))
    rows = listed.where(F.col("category").isin(*[f for f in LISTED if f in enabled])).select(family.alias("family"), key.alias("key"), F.coalesce(F.trim("match"), F.lit("")).alias("value"))
    return rows.where((F.col("key") != "") & ~F.col("key").isin(*K.NOISE_TOKENS) & F.col("family").isin(*enabled))


def patient_suggestions(notes: DataFrame, keys: list[str], text: str, dictionary: DataFrame, phrases: DataFrame, sure: DataFrame,
                        ambiguous: DataFrame, enabled: tuple[str, ...], listed: DataFrame | None = None) -> DataFrame:
    """Every enabled family with an occurrence in the note: one row per (note, family, source, match).

    All families are looked for together: the dictionary, phrases, ``listed`` suggestions, abbreviations and artefacts are one table with a family column, and one
    automaton finds them in one pass. Abbreviations are looked for as written."""
    unknown = sorted(set(enabled) - set(K.FAMILIES) - {"MANUAL_DICT"})
    if unknown:
        raise ValueError(f"unknown families {unknown}")
    none = F.lit(None).cast("string")
    shape = lambda df, family, source, match, note=none: df.select(
        *keys, family.alias("family"), source.alias("token_source"), match.alias("match"), F.col("occ").alias("patient_occ"), note.alias("note"))
    whole = lambda df, family, ignore_case=True: with_patterns(df, ignore_case).select(
        family.alias("family"), "key", "value", "cased", "guard", none.alias("base"), none.alias("note"), F.lit(0).alias("prio"))
    entries = []
    if "DICT" in enabled:
        entries.append(whole(dictionary.select("key", "value"), F.lit("DICT")))
    if "PHRASE_DICT" in enabled:
        entries.append(whole(phrases.select("key", "value"), F.lit("PHRASE_DICT")))
    if listed is not None and set(enabled) & set(LISTED):
        entries.append(whole(listed_entries(listed, enabled), F.col("family")))
    if "ABBREV_SURE" in enabled:
        entries.append(whole(sure.select("key", "value"), F.lit("ABBREV_SURE"), ignore_case=False))
    if "ABBREV_AMBIGU" in enabled:
        forms = ambiguous_forms(ambiguous).select(F.lit("ABBREV_AMBIGU").alias("family"), F.col("form").alias("key"), F.lit("").alias("value"), F.lit(True).alias("cased"), F.lit(False).alias("guard"),
                                                  F.col("key").alias("base"), F.concat(F.lit("Possibles : "), F.col("note")).alias("note"), "prio")
        entries.append(forms)
    if "NOISE" in enabled:
        noise = notes.sparkSession.createDataFrame([(t,) for t in K.NOISE_TOKENS], "key string")
        entries.append(noise.select(F.lit("NOISE").alias("family"), "key", F.lit("").alias("value"), F.lit(False).alias("cased"), F.lit(False).alias("guard"), none.alias("base"),
                                    F.lit("Artefact ETL (valeur manquante) – à ignorer").alias("note"), F.lit(0).alias("prio")))
    parts = []
    if entries:
        together = with_strategy(cut_lineage(reduce(DataFrame.unionByName, entries).distinct()))
        found = occurrences(notes, keys, text, together, "family", "base", "note", "prio")
        if "ABBREV_AMBIGU" in enabled:  # of the forms of an abbreviation the first that the note has
            first = found.where("base IS NOT NULL").groupBy(*keys, "base", "note").agg(F.min(F.struct("prio", "key", "occ")).alias("b"))
            parts.append(shape(first.withColumn("occ", F.col("b.occ")), F.lit("ABBREV_AMBIGU"), F.col("b.key"), F.lit(""), F.col("note")))
            found = found.where("base IS NULL")
        parts.append(shape(found, F.col("family"), F.col("key"), F.col("value"), F.col("note")))
    if "INTENSITY" in enabled:
        found = F.regexp_extract_all(F.col(text), F.lit(T.INTENSITY_TEXT), F.lit(0))
        counted = notes.select(*keys, F.explode(found).alias("tok")).groupBy(*keys, "tok").agg(F.count("*").alias("occ"))
        parts.append(shape(counted, F.lit("INTENSITY"), F.col("tok"), T.intensity_text(F.col("tok"))))
    if not parts:
        parts.append(shape(notes.where(F.lit(False)).withColumn("occ", F.lit(0).cast("long")), none, none, none))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("suggestion_key", F.concat_ws("::", "family", "token_source", "match")).withColumn(
        "is_auto", F.col("family").isin(*[name for name, (_, auto) in K.FAMILIES.items() if auto]) & (F.col("match") != ""))


def in_reading_order(suggestions: DataFrame, keys: list[str]) -> DataFrame:
    """The suggestions of a note next to each other, automatic ones first, then by family, occurrences and token. Notes are dealt out by
    key and sorted inside each task: no order among notes is needed."""
    return suggestions.repartition(*keys).sortWithinPartitions(*keys, F.desc("is_auto"), "family", F.desc("patient_occ"), "token_source")
