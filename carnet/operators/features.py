"""Text features, splits and resampling. Every split is a function of hashed keys: the same on each run and after a retry."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet.functions import text as T
from carnet.operators import correct as C
from carnet.operators import notes as N
from carnet.operators.ranking import rank_in_buckets, rank_in_hash_order, with_global_rank
from carnet.session import cut_lineage


def prepare_notes(notes: DataFrame, patient: str, order: str, text: str, dictionary: DataFrame | None = None, *, lower: bool = True, special: bool = True,
                  accents: bool = True, numbers: bool = True, concat: bool = True, stopwords: bool = True) -> DataFrame:
    """The configurable text chain: case, special characters, dictionary, accents, numbers, one text per patient, stop
    words. Result: patient (and order, unless joined to one text) and the token list."""
    c = F.col(text)
    c = F.lower(c) if lower else c
    c = T.remove_special(c) if special else c
    rows = notes.select(patient, order, c.alias("__text"))
    if dictionary is not None:
        rows = C.correct_tokens(rows, [patient, order], "__text", dictionary, alias="__text")
    c = F.col("__text")
    c = T.unaccent(c, "ascii") if accents else c
    c = F.array_join(T.drop_number_tokens(F.split(c, " ")), " ") if numbers else c
    rows = rows.select(patient, order, c.alias("__text"))
    if concat:
        rows = N.concat_by_id(rows, patient, order, "__text")
    tokens = T.words(F.col("__text"))
    return rows.select(patient, *([] if concat else [order]), (T.drop_stopwords(tokens) if stopwords else tokens).alias("tokens"))


def tf_idf(notes: DataFrame, keys: list[str], tokens: Column, max_vocab: int) -> DataFrame:
    """Weights (keys, term, weight): tf times ln((1 + n) / (1 + df)) + 1, rows scaled to length 1, over the
    ``max_vocab`` most frequent terms. Terms are counted inside each note before anything is shuffled between notes;
    the length is a window over one note's kept terms, at most ``max_vocab`` rows."""
    tf = notes.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    top = stats.orderBy(F.desc("cf"), "term").limit(max_vocab).select("term", "df")
    n = notes.agg(F.count("*").cast("double").alias("n")).scalar()
    weighted = tf.join(F.broadcast(top), "term").withColumn("w", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys)))
    return weighted.select(*keys, "term", F.round(F.col("w") / norm, 6).alias("weight"))


def hash_split(key: Column, fraction: float, seed: int = 42) -> Column:
    """'train' for a fixed share of keys, else 'test', by hash; needs no shuffle."""
    hashed = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.when(hashed < f"{int(fraction * 16 ** 8):08x}", "train").otherwise("test")


def stratified_split(df: DataFrame, label: str, key: str, fraction: float) -> DataFrame:
    """Exactly ``floor(fraction * size)`` rows of every class to train."""
    ranked = rank_in_hash_order(df, [label], key)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("group_size") * fraction), "train").otherwise("test")).drop("rank", "group_size")


def three_way_split(df: DataFrame, label: str, key: str, fraction: float) -> DataFrame:
    """A fixed share of every class to train; the rest halves into test and validation."""
    ranked = rank_in_hash_order(df, [label], key)
    n_train = F.round(F.col("group_size") * fraction)
    n_test = F.floor((F.col("group_size") - n_train) / 2)
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_test, "test").otherwise("validation")
    return ranked.withColumn("split", split).drop("rank", "group_size")


def patient_split(notes: DataFrame, patient: str, outcome: str) -> DataFrame:
    """80 / 10 / 10 over patients, stratified on the largest outcome of a patient; notes follow their patient."""
    patients = notes.groupBy(patient).agg(F.max(outcome).alias("__o"))
    ranked = rank_in_hash_order(patients, ["__o"], patient)
    split = F.when(F.col("rank") <= F.floor(F.col("group_size") * 0.8), "train").when(F.col("rank") <= F.floor(F.col("group_size") * 0.9), "validation").otherwise("test")
    return notes.join(ranked.select(patient, split.alias("split")), patient)


def fold_by_labels(df: DataFrame, labels: list[str], key: str, folds: int = 5) -> DataFrame:
    """Fold number such that each combination of labels is spread evenly over the folds. Combinations are dealt one after the other, each going on where the
    last one ended, so that rare ones do not all land in the first fold. Only one count per combination is summed up in one place."""
    combined = df.withColumn("__combo", F.struct(*labels))
    before = W.orderBy("__combo").rowsBetween(W.unboundedPreceding, -1)
    counts = combined.groupBy("__combo").agg(F.count("*").alias("__n")).select(F.col("__combo").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = rank_in_hash_order(combined, ["__combo"], key).join(counts, F.col("__combo").eqNullSafe(F.col("__c")))
    return ranked.withColumn("fold", ((F.col("rank") - 1 + F.col("__start")) % folds).cast("int")).drop("__combo", "__c", "__start", "rank", "group_size")


def stratified_plan(counts: dict[tuple, int], folds: int) -> dict[tuple, list[int]]:
    """Rows of each combination of label values for each fold, by iterative stratification on counts alone: the (label, value) with the fewest rows left is dealt
    first, each of its rows to the fold that still wants most rows of it, then most rows at all, then the first. Rows of one combination are alike, so they
    are dealt in bulk: whole levels at once, the last ones singly."""
    total = sum(counts.values())
    of_value: dict[tuple, int] = {}
    for combo, n in counts.items():
        for at in enumerate(combo):
            of_value[at] = of_value.get(at, 0) + n
    wanted = {value: [n / folds] * folds for value, n in of_value.items()}
    room = [total / folds] * folds
    left, remaining = dict(counts), dict(of_value)
    out = {combo: [0] * folds for combo in counts}
    order = lambda v: (remaining[v], v[0], v[1] is not None, str(v[1]))
    while open_ := [v for v, n in remaining.items() if n > 0]:
        value = min(open_, key=order)
        mine = sorted((c for c, n in left.items() if n and c[value[0]] == value[1]), key=lambda c: [(x is not None, str(x)) for x in c])
        for combo in mine:
            n, need = left.pop(combo), wanted[value]
            given = [0] * folds
            # Levels: as many rows to each fold as bring all down to one level, then the rest one by one.
            level = _level(need, n)
            for j in range(folds):
                given[j] = max(0, int(need[j] - level))
            for _ in range(n - sum(given)):
                j = max(range(folds), key=lambda j: (need[j] - given[j], room[j] - given[j], -j))
                given[j] += 1
            for j, k in enumerate(given):
                out[combo][j] += k
                room[j] -= k
                for at in enumerate(combo):
                    wanted[at][j] -= k
            for at in enumerate(combo):
                remaining[at] -= n
    return out


def _level(need: list[float], n: int) -> float:
    """A level such that taking the whole rows above it from every fold takes at most ``n``, and few are left over."""
    high = sorted(need, reverse=True)
    for j in range(len(high)):
        level = (sum(high[:j + 1]) - n) / (j + 1)
        if j + 1 == len(high) or level >= high[j + 1]:
            return level + 1
    return high[-1]


def fold_iteratively(df: DataFrame, labels: list[str], key: str, folds: int = 5) -> DataFrame:
    """Fold number by iterative stratification: every label's rows, and those of rare combinations, are spread over the folds as evenly as they go. The plan is made
    from the counts of label combinations; each combination's rows fill its places in hash order of ``key``."""
    combined = df.withColumn("__combo", F.struct(*[F.col(c).cast("string").alias(f"l{i}") for i, c in enumerate(labels)]))
    counts = {tuple(r["__combo"]): r["n"] for r in combined.groupBy("__combo").agg(F.count("*").alias("n")).collect()}
    ends = [(combo, list(accumulate(plan))) for combo, plan in stratified_plan(counts, folds).items()]
    inner = ", ".join(f"l{i}: string" for i in range(len(labels)))
    plan = df.sparkSession.createDataFrame(ends, f"__c struct<{inner}>, __ends array<long>")
    ranked = rank_in_hash_order(combined, ["__combo"], key).join(plan, F.col("__combo").eqNullSafe(F.col("__c")))
    fold = F.size(F.filter("__ends", lambda e: e < F.col("rank")))
    return ranked.withColumn("fold", fold.cast("int")).drop("__combo", "__c", "__ends", "rank", "group_size")


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class on the driver: one small row per class."""
    return {r[0]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


COPIES_PER_TASK = 4096


def upsample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Every class repeated in turn up to the size of the largest one; ``copy`` numbers the repeats of a row from 1.
    Rows repeated very often are first spread in blocks, so that no task produces them alone."""
    sizes = class_sizes(df, label)
    if not sizes:
        return df.withColumn("copy", F.lit(1).cast("long"))
    largest = max(sizes.values())
    copies = F.floor((F.lit(largest) - F.col("rank")) / F.col("group_size")) + 1
    ranked = rank_in_hash_order(df, [label], key).withColumn("__copies", copies)
    blocks = ranked.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / COPIES_PER_TASK))))
    if largest // min(sizes.values()) > COPIES_PER_TASK:
        blocks = blocks.repartition(key, "__block")
    first = F.col("__block") * COPIES_PER_TASK + 1
    last = F.least(F.col("__copies"), first + COPIES_PER_TASK - 1)
    return blocks.withColumn("copy", F.explode(F.sequence(first, last))).drop("rank", "group_size", "__copies", "__block")


def downsample(df: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of every class as the smallest one has, in hash order."""
    sizes = class_sizes(df, label)
    smallest = min(sizes.values()) if sizes else 0
    return rank_in_hash_order(df, [label], key).where(F.col("rank") <= smallest).drop("rank", "group_size")


def upsample_patients(notes: DataFrame, patient: str, order: str, outcome: str, bucket: Column) -> DataFrame:
    """Balance two classes by repeating the last minority notes of each patient in turn.

    Every patient gives its last ``k`` minority notes once more, ``k`` being the missing notes over the number of
    patients; the remainder is filled by going round the patients, one last note each, until the classes are equal.
    ``copy`` is 0 for original notes. ``bucket`` is monotone in ``order`` and bounds a ranking window.
    """
    sizes = class_sizes(notes, outcome)
    minority, majority = sorted((0, 1), key=lambda v: (sizes.get(v, 0), -v))
    missing = sizes.get(majority, 0) - sizes.get(minority, 0)
    n_patients = notes.select(patient).distinct().count()
    k = missing // n_patients if n_patients else 0
    ranked = rank_in_buckets(notes.where(F.col(outcome) == minority), [patient], bucket, [F.col(order)])
    # Ranked minority notes are read three times: written once.
    from_end = cut_lineage(ranked.withColumn("__back", F.col("group_size") - F.col("rank") + 1).drop("rank", "group_size"))
    tail = from_end.where(F.col("__back") <= k).withColumn("copy", F.lit(1).cast("long")).drop("__back")
    out = notes.withColumn("copy", F.lit(0).cast("long")).unionByName(tail)
    added = from_end.agg(F.count(F.when(F.col("__back") <= k, 1)).alias("n"), F.count(F.when(F.col("__back") == 1, 1)).alias("givers")).first()
    left, givers = missing - added["n"], added["givers"]
    if left > 0 and givers:
        lasts = with_global_rank(from_end.where(F.col("__back") == 1), [F.col(patient)], "__turn").drop("__back")
        rounds = F.lit(left // givers) + (F.col("__turn") <= left % givers).cast("long")
        # The copies of a giver are made in blocks, spread over the tasks when there are many.
        blocks = lasts.withColumn("__rounds", rounds).where("__rounds > 0").withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__rounds") - 1) / COPIES_PER_TASK))))
        if left // givers >= COPIES_PER_TASK:
            blocks = blocks.repartition(patient, "__block")
        first = F.col("__block") * COPIES_PER_TASK + 2
        extra = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("__rounds") + 1, first + COPIES_PER_TASK - 1))))
        out = out.unionByName(extra.drop("__turn", "__rounds", "__block"))
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) of each class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg((F.sum("n") / F.count("*")).alias("m")).scalar()
    return counts.select(label, F.round(total / F.col("n"), 6).alias("weight"))
