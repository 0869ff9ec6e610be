"""Correction suggestions per token family. Every family is a join on a computed key; none compares all pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from carnet import constants as K
from carnet.functions import text as T
from carnet.lookups import as_lookup
from carnet.session import cut_lineage

SUGGESTION_COLUMNS = ["token_source", "match", "count", "score", "edit_dist", "category", "expansions"]
# Words stand under about twenty keys each in the edit-distance join, so fewer of them may be broadcast.
EDIT_LOOKUP_ROWS = 20_000


def as_suggestion(df: DataFrame, category: str, match: Column | None = None, score: float = 0.0, edit_dist: int = 0,
                  expansions: Column | None = None) -> DataFrame:
    return df.select(
        F.col("token").alias("token_source"), (F.lit("") if match is None else match).alias("match"),
        F.col("n").alias("count"), F.lit(score).alias("score"), F.lit(edit_dist).alias("edit_dist"),
        F.lit(category).alias("category"), (F.lit("") if expansions is None else expansions).alias("expansions"))


def to_fix(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("status") != "valid")


def valid_words(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("status") == "valid").select(F.lower("token").alias("word")).distinct()


def accent_map(words: DataFrame) -> DataFrame:
    """First valid word (in code-point order) for each accent-stripped form."""
    content = words.where(~T.is_function_word(F.col("word")))
    return content.groupBy(T.unaccent(F.col("word")).alias("key")).agg(F.min("word").alias("accented"))


def adds_accents(token: Column, candidate: Column) -> Column:
    return (T.unaccent(token) == token) & (T.unaccent(candidate) != candidate) & (candidate != token)


def manual(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens found in the correction dictionary (key, value)."""
    joined = to_fix(tokens).join(dictionary, F.lower("token") == F.col("key"))
    return as_suggestion(joined, "MANUAL_DICT", F.col("value"), 100.0)


def accents_allowed() -> Column:
    """Tokens long enough for an accent correction, and not function words."""
    return (F.length("token") > 3) & ~T.is_function_word(F.col("token")) & (F.col("word_like") == 1)


def diacritics_strict(tokens: DataFrame) -> DataFrame:
    low = F.lower("token")
    candidates = to_fix(tokens).where(accents_allowed())
    joined = candidates.join(accent_map(valid_words(tokens)), T.unaccent(low) == F.col("key"))
    return as_suggestion(joined.where(adds_accents(low, F.col("accented"))), "DIACRITICS_STRICT", F.col("accented"), 100.0)


def diacritics_multi(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Accents restored word by word in tokens of several words. ``phrases`` has token and n."""
    parts = phrases.select("token", "n", F.posexplode(F.split(F.lower("token"), " ")).alias("pos", "word"))
    joined = parts.join(accent_map(words), T.unaccent(F.col("word")) == F.col("key"), "left")
    use = ~T.is_function_word(F.col("word")) & adds_accents(F.col("word"), F.col("accented"))
    mapped = joined.withColumn("use", F.coalesce(use, F.lit(False)))
    mapped = mapped.withColumn("out", F.when(F.col("use"), F.col("accented")).otherwise(F.col("word")))
    packed = F.array_sort(F.collect_list(F.struct("pos", "out")))
    rebuilt = mapped.groupBy("token", "n").agg(F.bool_or("use").alias("changed"), packed.alias("p"))
    match = F.array_join(F.transform("p", lambda s: s["out"]), " ")
    return as_suggestion(rebuilt.where("changed"), "DIACRITICS_MULTI", match, 100.0)


def is_upper_token(token: Column) -> Column:
    return token.rlike(K.UPPER_TOKEN_PATTERN)


def abbrev_sure(tokens: DataFrame, sure: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Upper-case tokens with exactly one known expansion. ``sure`` has key and value."""
    unclear = ambiguous.select("key")
    joined = tokens.where(is_upper_token(F.col("token"))).join(sure, F.upper("token") == F.col("key")).join(unclear, "key", "left_anti")
    return as_suggestion(joined, "ABBREV_SURE", F.col("value"), 100.0)


def abbrev_ambiguous(tokens: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Tokens with several expansions, left to the reader. ``ambiguous`` has key and expansions (array)."""
    joined = tokens.join(ambiguous, F.upper("token") == F.col("key"))
    return as_suggestion(joined, "ABBREV_AMBIGU", expansions=F.array_join("expansions", " | "))


def is_abbrev_candidate(token: Column) -> Column:
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(token, r"[^\p{Lu}]", ""))
    lower = F.length(F.regexp_replace(token, r"[^\p{Ll}]", ""))
    shape = token.contains(".") | ((letters >= 2) & (upper >= 2) & (lower == 0))
    return (F.length(token) <= K.ABBREV_MAX_LEN) & shape


def candidate_rule() -> Column:
    return ((F.col("word_like") == 1) & ~F.lower("token").isin(*K.ABBREVIATION_STOPWORDS)
            & (F.col("zipf") <= K.ZIPF_ABBREV_MAX) & is_abbrev_candidate(F.col("token")))


def abbrev_candidate(tokens: DataFrame, sure: DataFrame, ambiguous: DataFrame) -> DataFrame:
    known = sure.where(is_upper_token(F.col("key"))).select("key").unionByName(ambiguous.select("key"))
    rare = tokens.where(candidate_rule())
    return as_suggestion(rare.join(known, F.upper("token") == F.col("key"), "left_anti"), "ABBREV_CANDIDATE")


def intensity(tokens: DataFrame) -> DataFrame:
    marked = to_fix(tokens).withColumn("__m", T.intensity_token(F.lower("token")))
    return as_suggestion(marked.where(F.col("__m").isNotNull()), "INTENSITY", F.col("__m"), 100.0)


def _deletions(df: DataFrame, word: str) -> DataFrame:
    """One row per position of each word: ``__pos``, the word without that letter (``__rest``), and whether it is the
    first of a run of equal letters, so that each distinct rest can be taken once (``__once``)."""
    w, pos = F.col(word), F.col("__pos")
    rows = df.where(F.length(w) > 0).select("*", F.explode(F.sequence(F.lit(1), F.length(w))).alias("__pos"))
    rest = F.concat(F.substring(w, F.lit(1), pos - 1), F.substring(w, pos + 1, F.length(w)))
    return rows.select("*", rest.alias("__rest"), ((pos == 1) | (F.substring(w, pos, F.lit(1)) != F.substring(w, pos - 1, F.lit(1)))).alias("__once"))


def _edit_keys(df: DataFrame, word: str, own_deletion: str, whole: str) -> DataFrame:
    """Keys of 64 bits, so a key row has the same size for every word."""
    cut = _deletions(df, word)
    same_place = F.xxhash64(F.lit("S"), F.col("__pos"), F.col("__rest"))
    shorter = F.when(F.col("__once"), F.xxhash64(F.lit(own_deletion), F.lit(0), F.col("__rest")))
    cut = cut.select(*df.columns, F.explode(F.array(same_place, shorter)).alias("__k")).where(F.col("__k").isNotNull())
    return cut.unionByName(df.select("*", F.xxhash64(F.lit(whole), F.lit(0), F.col(word)).alias("__k")))


def edit1_pairs(left: DataFrame, right: DataFrame, left_word: str, right_word: str) -> DataFrame:
    """All (left, right) word pairs at edit distance exactly 1, found by equality joins only.

    Two words differ by one substitution when deleting the same position gives the same rest, and by one insertion when
    a deletion of one is the other. Keys carry the case they stand for, so each pair is found once; a pair is then checked, as
    keys are hashes. Left words longer than any right word by more than one letter get no keys. The number of partners of a
    key is bounded by the alphabet, not by the data. ``right`` is read twice: hand over a stored table.
    """
    longest = right.agg(F.max(F.length(right_word))).first()[0] or 0
    a = _edit_keys(left.where(F.length(left_word) <= longest + 1), left_word, "R:", "L:")
    b = _edit_keys(right, right_word, "L:", "R:")
    return a.join(b, "__k").where(F.levenshtein(left_word, right_word) == 1).drop("__k")


def typo_eligible() -> Column:
    """Word-like tokens of five letters or more: no digit, hyphen, dot or apostrophe, not all capitals, not frequent."""
    t = F.col("token")
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    all_caps = (letters != "") & (F.regexp_replace(letters, r"\p{Lu}", "") == "")
    return ((F.col("word_like") == 1) & (F.length(t) >= 5) & ~t.rlike(r"[\p{Nd}\-.'’]") & ~all_caps
            & ~((F.col("zipf") > 0) & (F.col("zipf") >= K.ZIPF_TYPO_MAX)))


def typo_matches(tokens: DataFrame) -> DataFrame:
    """(word, match) for lower-case eligible tokens: first valid word at distance 1, kept when clearly more frequent."""
    wanted = to_fix(tokens).where(typo_eligible()).select(F.lower("token").alias("word"), "zipf").distinct()
    valid = tokens.where(F.col("status") == "valid").select(F.lower("token").alias("valid"), F.col("zipf").alias("zipf_valid")).distinct()
    valid = as_lookup(valid, EDIT_LOOKUP_ROWS)
    first = edit1_pairs(wanted, valid, "word", "valid").groupBy("word", "zipf").agg(F.min(F.struct("valid", "zipf_valid")).alias("b"))
    gain_ok = (F.col("b.zipf_valid") == 0) | (F.col("zipf") == 0) | (F.col("b.zipf_valid") - F.col("zipf") >= 1.0)
    return first.where(gain_ok).select("word", F.col("b.valid").alias("match"))


def typo(tokens: DataFrame) -> DataFrame:
    eligible = to_fix(tokens).where(typo_eligible())
    return as_suggestion(eligible.join(typo_matches(tokens), F.lower("token") == F.col("word")), "TYPO", F.col("match"), 90.0, 1)


def enrich_rule() -> Column:
    return (F.col("word_like") == 1) & (F.col("zipf") <= K.ZIPF_ENRICH_MAX)


def enrich(tokens: DataFrame) -> DataFrame:
    return as_suggestion(to_fix(tokens).where(enrich_rule()), "ENRICH_METIER")


def suggest_all(tokens: DataFrame, dictionary: DataFrame, sure: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Every family in priority order, one row per token: a single pass over the vocabulary with one lookup per family.
    ``tokens`` is read several times: hand over a written or checkpointed vocabulary."""
    low, up = F.lower("token"), F.upper("token")
    rows = tokens
    rows = rows.join(dictionary.select(F.col("key").alias("dk"), F.col("value").alias("dv")), low == F.col("dk"), "left")
    rows = rows.join(accent_map(valid_words(tokens)).withColumnRenamed("key", "ak"), T.unaccent(low) == F.col("ak"), "left")
    rows = rows.join(sure.select(F.col("key").alias("sk"), F.col("value").alias("sv")), up == F.col("sk"), "left")
    rows = rows.join(ambiguous.select(F.col("key").alias("mk"), F.array_join("expansions", " | ").alias("mv")), up == F.col("mk"), "left")
    rows = rows.join(typo_matches(tokens).select(F.col("word").alias("tk"), F.col("match").alias("tv")), low == F.col("tk"), "left")
    several = to_fix(tokens).where(F.col("token").contains(" ")).select("token", "n")
    several = diacritics_multi(several, valid_words(tokens)).select(F.col("token_source").alias("pk"), F.col("match").alias("pv"))
    rows = rows.join(several, F.col("token") == F.col("pk"), "left")
    fix = F.col("status") != "valid"
    mark = T.intensity_token(low)
    is_sure = F.col("sk").isNotNull() & is_upper_token(F.col("token"))
    rules = [
        ("MANUAL_DICT", fix & F.col("dk").isNotNull(), F.col("dv"), 100.0, 0),
        ("DIACRITICS_STRICT", fix & accents_allowed() & F.coalesce(adds_accents(low, F.col("accented")), F.lit(False)), F.col("accented"), 100.0, 0),
        ("DIACRITICS_MULTI", fix & F.col("pk").isNotNull(), F.col("pv"), 100.0, 0),
        ("ABBREV_AMBIGU", F.col("mk").isNotNull(), F.lit(""), 0.0, 0),
        ("ABBREV_SURE", is_sure, F.col("sv"), 100.0, 0),
        ("ABBREV_CANDIDATE", candidate_rule(), F.lit(""), 0.0, 0),
        ("INTENSITY", fix & mark.isNotNull(), mark, 100.0, 0),
        ("TYPO", fix & typo_eligible() & F.col("tk").isNotNull(), F.col("tv"), 90.0, 1),
        ("ENRICH_METIER", fix & enrich_rule(), F.lit(""), 0.0, 0),
        ("REJECTED", fix, F.lit(""), 0.0, 0),
    ]
    rules.sort(key=lambda r: K.FAMILY_PRIORITY.index(r[0]))
    chosen = F.coalesce(*[F.when(cond, F.struct(match.alias("match"), F.lit(score).alias("score"), F.lit(dist).alias("edit_dist"),
                                                F.lit(name).alias("category"))) for name, cond, match, score, dist in rules])
    # Whatever is to be fixed has a family, if only the last: no rule but the three that also hold for valid tokens is worked out to choose rows.
    picked = rows.where(fix | F.col("mk").isNotNull() | is_sure | candidate_rule()).withColumn("__s", chosen)
    return picked.select(
        F.col("token").alias("token_source"), F.col("__s.match").alias("match"), F.col("n").alias("count"), F.col("__s.score").alias("score"),
        F.col("__s.edit_dist").alias("edit_dist"), F.col("__s.category").alias("category"),
        F.when(F.col("__s.category") == "ABBREV_AMBIGU", F.col("mv")).otherwise(F.lit("")).alias("expansions"))


def families() -> list[tuple[str, str, bool]]:
    return [(name, label, auto) for name, (label, auto) in K.FAMILIES.items()]


def with_automatic(suggestions: DataFrame) -> DataFrame:
    """Label and automatic flag of each suggestion: the family allows it and there is a match.
    The family table is a fixed list of fourteen rows, so it is a literal expression rather than a join."""
    label, auto = F.lit(None).cast("string"), F.lit(False)
    for name, family_label, family_auto in reversed(families()):
        label = F.when(F.col("category") == name, F.lit(family_label)).otherwise(label)
        auto = F.when(F.col("category") == name, F.lit(family_auto)).otherwise(auto)
    return suggestions.withColumn("family_label", F.coalesce(label, F.col("category"))).withColumn("is_auto", auto & (F.length("match") > 0))


# How many edits a score allows two words of lengths n and o, and which lengths o can then have. The edit score is
# 100 * (1 - distance / longer length); the indel score counts insertions and deletions against both lengths and is
# rounded to an integer, so half a point is allowed for.
SCORERS = {
    "edit": ("{slack} * greatest(n, o) div 100", "n * {cutoff} div 100", "n * 100 div {cutoff} + 1"),
    "indel": ("(2 * {slack} + 1) * (n + o) div 200", "n * (2 * {cutoff} - 1) div (401 - 2 * {cutoff})", "n * (401 - 2 * {cutoff}) div (2 * {cutoff} - 1) + 1"),
}


def _pieces(df: DataFrame, word: str, cutoff: int, own: bool, scorer: str, lengths: list[int]) -> DataFrame:
    """(word, __k): keys under which two words scoring at least ``cutoff`` must meet. A searched word only gets keys for the
    ``lengths`` that words of the lexicon have: one that no such length can match gets none, however long it is.

    A score allows some number k of edits. Cut the lexicon word in k + 1 pieces: at least one piece survives untouched in
    the other word, moved by at most k places. ``own`` gives the pieces of the lexicon word, otherwise every place of the
    searched word where a piece could be. ``o`` is the other word's length.
    """
    edits, shortest, longest = (e.format(cutoff=cutoff, slack=100 - cutoff) for e in SCORERS[scorer])
    rows = df.where(F.length(word) > 0).select(word, F.length(word).alias("n"))
    if own:
        rows = rows.withColumn("o", F.expr(f"explode(sequence(greatest(1, {shortest}), {longest}))"))
    else:
        rows = rows.withColumn("o", F.expr(f"explode(filter(array({', '.join(map(str, lengths))}), x -> x between greatest(1, {shortest}) and {longest}))"))
    rows = rows.withColumn("k", F.expr(edits)).where("abs(n - o) <= k")
    lex, other = ("n", "o") if own else ("o", "n")
    # More pieces than letters: an empty piece always survives, so such words meet under their lengths alone.
    rows = rows.withColumn("i", F.expr(f"explode(if(k >= {lex}, array(-1L), sequence(0L, k)))"))
    rows = rows.withColumn("size", F.expr(f"if(i < 0, 0, {lex} div (k + 1) + if(i >= k + 1 - {lex} % (k + 1), 1, 0))"))
    rows = rows.withColumn("start", F.expr(f"if(i < 0, 0, i * ({lex} div (k + 1)) + greatest(0, i - (k + 1 - {lex} % (k + 1))))"))
    if own:
        rows = rows.withColumn("at", F.col("start"))
    else:
        rows = rows.where("i < 0 OR greatest(0, start - k) <= least(n - size, start + k)")
        rows = rows.withColumn("at", F.expr("explode(if(i < 0, array(0L), sequence(greatest(0, start - k), least(n - size, start + k))))"))
    key = F.expr(f"xxhash64(cast({lex} AS INT), cast({other} AS INT), cast(i AS INT), substring({word}, cast(at AS INT) + 1, cast(size AS INT)))")
    return rows.select(word, key.alias("__k"))


def _indel_score():
    """Indel score of word pairs in Arrow batches, from the length of the longest common subsequence (bit-parallel)."""

    @F.pandas_udf(TY.DoubleType())
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            places: dict[str, int] = {}
            for i, ch in enumerate(a):
                places[ch] = places.get(ch, 0) | 1 << i
            every = (1 << len(a)) - 1
            state = every
            for ch in b:
                hit = state & places.get(ch, 0)
                state = (state + hit) | (state - hit)
            common = (~state & every).bit_count()
            return float(round(200.0 * common / (len(a) + len(b))))

        return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="float64")

    return score


def fuzzy_pairs(words: DataFrame, lexicon: DataFrame, word: str = "word", lex: str = "lex", cutoff: int = 80, scorer: str = "edit") -> DataFrame:
    """(word, lex, score) for every pair scoring at least ``cutoff``. Exact: candidates come from equality of pieces, and
    only candidates are measured."""
    lengths = sorted(r[0] for r in lexicon.select(F.length(lex)).where(F.length(lex) > 0).distinct().collect())
    if not lengths:
        lengths = [0]
    a, b = _pieces(words, word, cutoff, False, scorer, lengths), _pieces(lexicon, lex, cutoff, True, scorer, lengths)
    pairs = a.join(b, "__k").select(word, lex)
    if scorer == "indel":
        return pairs.distinct().withColumn("score", _indel_score()(F.col(word), F.col(lex))).where(F.col("score") >= cutoff)
    score = F.round(100.0 * (1 - F.levenshtein(word, lex) / F.greatest(F.length(word), F.length(lex))), 2)
    return pairs.select(word, lex, score.alias("score")).where(F.col("score") >= cutoff).distinct()
