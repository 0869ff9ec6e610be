"""Keyword contexts and entity mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.functions import text as T
from carnet.lookups import as_lookup, small_entries, sql_list
from carnet.operators.ranking import top_per_group
from carnet.operators.suggest import fuzzy_pairs


def windows(df: DataFrame, keys: list[str], words: Column, wanted, n: int) -> DataFrame:
    """Context of ``n`` words on each side of every word for which ``wanted(word)`` holds, one row per hit.
    The word list stays in its row: only hit positions are exploded."""
    listed = df.select(*keys, words.alias("__w"), *[c for c in ("hitset",) if c in df.columns])
    places = F.filter(F.transform("__w", lambda w, i: F.when(wanted(w), i)), lambda i: i.isNotNull())
    around = F.transform(places, lambda i: F.struct(i.alias("pos"), F.array_join(
        F.slice(F.col("__w"), F.greatest(i - n, F.lit(0)) + 1, i + n + 1 - F.greatest(i - n, F.lit(0))), " ").alias("context")))
    return listed.select(*keys, F.explode(around).alias("__h")).select(*keys, "__h.pos", "__h.context")


def kwic_prefix(df: DataFrame, keys: list[str], text: str, prefix: str, n: int = 5) -> DataFrame:
    return windows(df, keys, T.plain_words(F.col(text)), lambda w: F.lower(w).startswith(prefix), n)


def kwic_word(df: DataFrame, keys: list[str], text: str, word: str, n: int = 3) -> DataFrame:
    return windows(df, keys, T.plain_words(F.col(text)), lambda w: F.lower(w) == word.lower(), n)


def _plain(w: Column) -> Column:
    return T.unaccent(F.lower(w))


def _lower(w: Column) -> Column:
    return F.lower(w)


def close_words(df: DataFrame, keys: list[str], text: str, keywords: DataFrame, cutoff: int, scorer: str = "edit") -> DataFrame:
    """(keys, word, lex) for the words of each note close to a keyword: accents aside with the edit score, as written with
    the indel score. Distinct words of the corpus are scored once, and the few close ones are looked up in the notes."""
    form = _lower if scorer == "indel" else _plain
    per_note = df.select(*keys, F.explode(F.array_distinct(F.transform(T.plain_words(F.col(text)), form))).alias("word"))
    close = fuzzy_pairs(per_note.select("word").distinct(), keywords, cutoff=cutoff, scorer=scorer).select("word", "lex")
    return per_note.join(as_lookup(close), "word")


def kwic_fuzzy(df: DataFrame, keys: list[str], text: str, keywords: DataFrame, n: int = 10, cutoff: int = 80, scorer: str = "edit") -> DataFrame:
    """Context of words close to a keyword (column ``lex``): hits are gathered per note, contexts are cut inside it."""
    form = _lower if scorer == "indel" else _plain
    hits = close_words(df, keys, text, keywords, cutoff, scorer).groupBy(*keys).agg(F.collect_set("word").alias("hitset"))
    return windows(df.join(hits, keys), keys, T.plain_words(F.col(text)), lambda w: F.array_contains("hitset", form(w)), n)


def topic_hits(df: DataFrame, keys: list[str], text: str, topics: DataFrame) -> DataFrame:
    """Topics (topic, keyword) met in each note, with the number of distinct keywords met."""
    words = df.select(*keys, F.explode(F.array_distinct(F.transform(T.plain_words(F.col(text)), lambda w: F.lower(w)))).alias("keyword"))
    return words.join(topics, "keyword").groupBy(*keys, "topic").agg(F.count("*").alias("n_keywords"))


def topic_flags(df: DataFrame, keys: list[str], text: str, topics: dict[str, tuple[str, ...]], cutoff: int = 80, scorer: str = "indel", exact: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Hit / no hit for each note and each of a fixed list of topics, by fuzzy keyword match; ``exact`` gives abbreviations of topics that
    only match as whole words, in any case of letters."""
    form = _lower if scorer == "indel" else _plain
    listed = df.sparkSession.createDataFrame([(topic, k) for topic, ks in topics.items() for k in ks], "topic string, lex string").select("topic", form(F.col("lex")).alias("lex"))
    met = close_words(df, keys, text, listed.select("lex").distinct(), cutoff, scorer).join(F.broadcast(listed), "lex")
    met = met.select(*keys, "topic")
    if exact:
        words = F.transform(T.plain_words(F.col(text)), lambda w: F.lower(w))
        found = F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(a.lower()) for a in listed_])), F.lit(topic)) for topic, listed_ in exact.items()]))
        met = met.unionByName(df.select(*keys, F.explode(found).alias("topic")))
    hits = met.groupBy(*keys).agg(F.collect_set("topic").alias("__t"))
    flags = F.array(*[F.struct(F.lit(t).alias("topic"), F.coalesce(F.array_contains("__t", t), F.lit(False)).alias("hit")) for t in topics])
    return df.select(*keys).join(hits, keys, "left").select(*keys, F.explode(flags).alias("f")).select(*keys, "f.topic", "f.hit")


def ngram_mentions(df: DataFrame, keys: list[str], text: str, gazetteer: DataFrame) -> DataFrame:
    """Mentions of gazetteer terms (term, label) among the word sequences of a note, up to the longest term, with their position.
    Terms of a small gazetteer are picked out inside the note, so only mentions leave it; ``gazetteer`` should be stored."""
    ts = df.select(*keys, T.norm_tokens(F.col(text)).alias("__t"))
    terms = small_entries(gazetteer.select(F.col("term").alias("key"), F.col("label").alias("value")))
    longest = gazetteer.agg(F.max(F.size(F.split("term", " ")))).first()[0]
    if not longest:
        return ts.select(*keys, F.lit(0).alias("pos"), F.lit("").alias("term"), F.lit("").alias("label"), F.lit(1.0).alias("score")).where(F.lit(False))
    sequences = ", ".join(f"if(i + {n} <= size(__t), struct(cast(i AS INT) AS pos, array_join(slice(__t, i + 1, {n}), ' ') AS term), null)" for n in range(1, longest + 1))
    if terms is None:
        starts, wanted = "sequence(0, size(__t) - 1)", "g IS NOT NULL"
    else:
        starts = f"filter(transform(__t, (t, i) -> if(t IN ({sql_list({k.split(' ')[0] for k in terms})}), i, null)), i -> i IS NOT NULL)"
        wanted = f"g.term IN ({sql_list(terms)})"
    found = F.expr(f"flatten(transform({starts}, i -> filter(array({sequences}), g -> {wanted})))")
    long = ts.where(F.size("__t") > 0).select(*keys, F.explode(found).alias("g")).select(*keys, "g.pos", "g.term")
    return long.join(gazetteer.select("term", "label"), "term").select(*keys, "pos", "term", "label", F.lit(1.0).alias("score"))


def first_mentions(entities: DataFrame, patient: str) -> DataFrame:
    """First mention of each term per patient, as an aggregate (no per-patient window)."""
    first = entities.groupBy(patient, "term").agg(F.min(F.struct("pos", "label", "score")).alias("m"))
    return first.select(patient, "term", "m.pos", "m.label", "m.score")


def group_frequency(entities: DataFrame, outcome: str, n: int) -> DataFrame:
    counted = entities.where(F.length("term") > 2).groupBy("label", outcome, "term").agg(F.count("*").alias("frequency"))
    return top_per_group(counted, ["label", outcome], [F.desc("frequency"), F.asc("term")], n)


def only_in_group(entities: DataFrame, patient: str, outcome: str, positive, patients: DataFrame) -> DataFrame:
    """Terms of the positive group that the other group never has, with frequency and share of the group's patients."""
    freq = entities.groupBy("term").agg(
        F.count(F.when(F.col(outcome) == positive, 1)).alias("frequency"), F.count(F.when(F.col(outcome) != positive, 1)).alias("__other"))
    size = patients.where(F.col(outcome) == positive).agg(F.countDistinct(patient).cast("double").alias("n")).scalar()
    only = freq.where((F.col("frequency") > 0) & (F.col("__other") == 0)).drop("__other")
    return only.withColumn("percentage", F.round(100.0 * F.col("frequency") / size, 6))


def relative_frequency(entities: DataFrame, patient: str, outcome: str, patients: DataFrame, cutoff: int = 10) -> DataFrame:
    """Frequencies of each term in both groups (outcome 1 and 0), absolute and relative to the group size, above a cut-off in one of them."""
    freq = entities.groupBy("term").agg(F.count(F.when(F.col(outcome) == 1, 1)).alias("n_with"), F.count(F.when(F.col(outcome) == 0, 1)).alias("n_without"))
    size = lambda v: patients.where(F.col(outcome) == v).agg(F.countDistinct(patient).cast("double").alias("n")).scalar()
    kept = freq.where((F.col("n_with") >= cutoff) | (F.col("n_without") >= cutoff))
    return (kept.withColumn("rel_with", F.round(F.col("n_with") / size(1), 6)).withColumn("rel_without", F.round(F.col("n_without") / size(0), 6))
            .withColumn("total", F.col("n_with") + F.col("n_without")).orderBy(F.desc("total"), "term"))


def feature_table(entities: DataFrame, feature: str, n: int = 20) -> DataFrame:
    """Counts of the most frequent terms by feature value, absent and present side by side."""
    counted = entities.groupBy("term").agg(F.count("*").alias("__n"), F.count(F.when(F.col(feature) == 0, 1)).alias("absent"),
                                           F.count(F.when(F.col(feature) == 1, 1)).alias("present"))
    return counted.orderBy(F.desc("__n"), "term").limit(n).drop("__n")
