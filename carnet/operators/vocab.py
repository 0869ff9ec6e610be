"""Vocabulary of a corpus: counts, zipf frequency, word classes, validity, token indexes."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet import constants as K
from carnet.functions import text as T
from carnet.session import cut_lineage

# Workers get the lookup with the task, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def vocab_count(df: DataFrame, tokens: Column, token: str = "token", count: str = "n") -> DataFrame:
    """Token frequencies; partial counts are merged on the map side before the shuffle."""
    return df.select(F.explode(tokens).alias(token)).groupBy(token).agg(F.count("*").alias(count))


def doc_frequency(df: DataFrame, tokens: Column, token: str = "token", count: str = "n_docs") -> DataFrame:
    """Number of notes holding each token; duplicates inside a note go away before the shuffle."""
    return vocab_count(df, F.array_distinct(tokens), token, count)


def with_zipf(vocab: DataFrame, reference: DataFrame, token: str = "token") -> DataFrame:
    """``log10`` of the frequency per billion in a reference corpus (token, n); 0 for unknown tokens."""
    total = reference.agg(F.sum("n")).scalar()
    known = reference.select(F.col("token").alias("__t"), F.round(F.log10(F.col("n") * 1e9 / total), 2).alias("__z"))
    joined = vocab.join(known, F.lower(F.col(token)) == F.col("__t"), "left")
    return joined.withColumn("zipf", F.coalesce("__z", F.lit(0.0))).drop("__t", "__z")


def with_validity(vocab: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """valid / to_fix / invalid for each token that carries a zipf value. ``lexicon`` has one column ``word``."""
    t = F.col(token)
    low = F.lower(t)
    accented_twin = F.max(T.has_diacritics(t)).over(W.partitionBy("__key"))
    known = lexicon.select(F.col("word").alias("__w")).distinct()
    joined = vocab.withColumn("__key", T.unaccent(low)).withColumn("__twin", accented_twin)
    joined = joined.join(known, low == F.col("__w"), "left")
    status = (
        F.when(T.is_function_word(t), "valid")
        .when(~T.is_word_like(t), "invalid")
        .when((F.col("__key") != "") & F.col("__twin") & ~T.has_diacritics(t), "to_fix")
        .when(F.col("__w").isNotNull() | (F.col("zipf") >= K.ZIPF_VALID_MIN), "valid")
        .otherwise("invalid")
    )
    return (joined.withColumn("word_like", T.is_word_like(t).cast("int")).withColumn("status", status)
            .drop("__key", "__twin", "__w"))


def with_word_class(vocab: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """Class of a distinct token: known, to_correct, number, quantity, single, degree, volume, mixed."""
    t = F.replace(F.col(token), F.lit("®"), F.lit(""))
    known = lexicon.select(F.col("word").alias("__w")).distinct()
    joined = vocab.join(known, F.lower(F.col(token)) == F.col("__w"), "left")
    kind = (
        F.when(t.rlike(r"^\p{Nd}+$"), "number")
        .when(t.rlike(r"^\p{L}+$") & F.col("__w").isNotNull(), "known")
        .when(t.rlike(r"^\p{L}+$"), "to_correct")
        .when(t.rlike(r"\p{Nd}"), "quantity")
        .when(F.length(t) <= 1, "single")
        .when(t.contains("°"), "degree")
        .when(t.contains("³"), "volume")
        .otherwise("mixed")
    )
    return joined.withColumn("kind", kind).drop("__w")


def is_noise(token: Column, zipf: Column) -> Column:
    return (token.rlike(r"^\p{Nd}+$") | (F.length(token) <= 2) | (zipf >= K.ZIPF_ABBREV_NOISE)
            | F.lower(token).isin(*K.FRENCH_STOPWORDS))


def looks_medical(token: Column) -> Column:
    low = F.lower(token)
    starts = F.lit(False)
    for prefix in K.MEDICAL_PREFIXES:
        starts = starts | low.startswith(prefix)
    ends = F.lit(False)
    for suffix in K.MEDICAL_SUFFIXES:
        ends = ends | low.endswith(suffix)
    return low.isin(*K.MEDICAL_WHITELIST) | starts | ends


def is_medical_abbreviation(token: Column, zipf: Column) -> Column:
    return ~is_noise(token, zipf) & F.length(token).between(3, 8) & looks_medical(token)


def top_suggestion_per_token(df: DataFrame, token: str, count: str, others: list[str]) -> DataFrame:
    """One row per token, the one with the highest count (ties by the other columns), as an aggregate."""
    best = F.min(F.struct((-F.col(count)).alias("k"), *others))
    kept = df.groupBy(token).agg(best.alias("__b"))
    return kept.select(token, (-F.col("__b.k")).alias(count), *[F.col(f"__b.{c}").alias(c) for c in others])


def lexicon_from_columns(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct lower-case words of several label columns."""
    parts = [df.select(F.explode(T.norm_tokens(F.col(c))).alias("word")) for df, c in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def token_index(vocab: DataFrame, max_vocab: int) -> DataFrame:
    """Ids of the most frequent tokens; 1 is kept for unknown tokens. At most ``max_vocab`` rows, found by top-k."""
    top = vocab.orderBy(F.desc("n"), "token").limit(max(max_vocab - 2, 0))
    rank = F.row_number().over(W.orderBy(F.desc("n"), "token"))
    return top.select("token", (rank + 1).alias("token_id"))


#: Ids that a slice of the index holds, and its characters at most.
SLICE_ROWS, SLICE_CHARS = 500_000, 16 << 20


def _ids(shared: Broadcast):
    """Ids of the tokens of each list that a broadcast dictionary knows, 0 for others. Each distinct token of a batch is looked up once."""

    @F.arrow_udf("array<int>")
    def look_up(lists: pa.Array) -> pa.Array:
        held = shared.value
        coded = lists.flatten().dictionary_encode()
        ids = pa.array([held.get(t, 0) for t in coded.dictionary.to_pylist()], pa.int32())
        lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), ids.take(coded.indices))

    return look_up.asNondeterministic()


def index_tokens(df: DataFrame, keys: list[str], tokens: Column, index: DataFrame, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> DataFrame:
    """Rows (keys, ids): the token ids of each note, looked up inside the row; no token is moved. The index (token, token_id) is broadcast; one beyond the
    bounds in slices by hash, each of which fills in the tokens it knows. Unknown tokens get 1."""
    index = cut_lineage(index.select("token", "token_id"))
    n, size = index.agg(F.count("*"), F.sum(F.length("token"))).first()
    parts = max(1, -(-n // rows), -(-(size or 0) // chars))
    out = df.select(*keys, F.coalesce(tokens, F.array().cast("array<string>")).alias("__tokens"))
    for part in range(parts if n else 0):
        mine = index if parts == 1 else index.where(F.pmod(F.xxhash64("token"), F.lit(parts)) == part)
        held = df.sparkSession.sparkContext.broadcast({r["token"]: r["token_id"] for r in mine.collect()})
        found = _ids(held)(F.col("__tokens"))
        out = out.withColumn("__ids", found if part == 0 else F.zip_with("__ids", found, lambda a, b: a + b))
        out = cut_lineage(out) if parts > 1 else out
    ids = F.transform("__ids", lambda i: F.when(i == 0, 1).otherwise(i)) if n else F.transform("__tokens", lambda t: F.lit(1))
    return out.select(*keys, ids.alias("ids"))


def padded(ids: Column, width: Column) -> Column:
    """Zeros on the left up to a width."""
    return F.concat(F.array_repeat(F.lit(0), width - F.size(ids)), ids)


def index_and_pad(df: DataFrame, keys: list[str], tokens: Column, index: DataFrame) -> DataFrame:
    """Token ids of each note, zero-padded on the left to the longest note: the full-length view."""
    rows = index_tokens(df, keys, tokens, index)
    longest = df.agg(F.coalesce(F.max(F.size(tokens)), F.lit(0))).first()[0]
    return rows.select(*keys, padded(F.col("ids"), F.lit(max(longest, 0))).alias("ids"))


def padded_batches(rows: DataFrame, keys: list[str], batch_rows: int = 1024) -> DataFrame:
    """Batches for training: notes of like length together (widths are powers of two), each padded to the width of its batch only, with ``width`` and ``batch``. Every
    width is dealt into batches of about ``batch_rows`` notes by hash of the keys, so a width that most notes have is many batches."""
    width = F.when(F.size("ids") <= 1, 1).otherwise(F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(F.size("ids").cast("double"))).cast("int"))).cast("int")
    sized = rows.withColumn("width", width)
    counts = cut_lineage(sized.groupBy("width").agg(F.ceil(F.count("*") / batch_rows).alias("__batches")))
    dealt = sized.join(F.broadcast(counts), "width")  # one row per power of two
    return dealt.select(*keys, "width", F.pmod(F.xxhash64(*keys), F.col("__batches")).alias("batch"), padded(F.col("ids"), F.col("width")).alias("ids"))
