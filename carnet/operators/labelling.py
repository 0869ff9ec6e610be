"""Long-text chunks, model answers and their merge into one label per patient."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet import constants as K
from carnet.operators.ranking import rank_in_hash_order, top_per_group


def chunk(df: DataFrame, keys: list[str], text: str, size: int = 5000, overlap: float = 0.2) -> DataFrame:
    """Overlapping character windows of each text; the last one is aligned to the end. The whole text is covered."""
    step = int(size * (1 - overlap))
    n = F.length(text)
    full = F.floor((n - size) / step).cast("int")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), full), lambda i: i * step),
        F.when(full * step + size < n, F.array(n - size)).otherwise(F.array().cast("array<int>"))))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(F.col(text), s + 1, F.lit(size)).alias("part")))
    return df.select(*keys, F.posexplode(parts).alias("chunk", "__c")).select(*keys, "chunk", "__c.start", "__c.part")


def vote(chunks: DataFrame, keys: list[str], order: str, label: str, reason: str) -> DataFrame:
    """One label per text: any 'oui' wins, else any 'non', else 'ambigue'; the reason comes from the first deciding chunk."""
    known = chunks.where(F.col(label).isNotNull())
    grouped = known.groupBy(*keys).agg(
        F.min(F.when(F.col(label) == "oui", F.struct(order, reason))).alias("yes"), F.min(F.when(F.col(label) == "non", F.struct(order, reason))).alias("no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, reason))), lambda s: s[reason]), " ").alias("all"))
    return grouped.select(*keys, F.when(F.col("yes").isNotNull(), "oui").when(F.col("no").isNotNull(), "non").otherwise("ambigue").alias("classification"),
                          F.coalesce(F.col(f"yes.{reason}"), F.col(f"no.{reason}"), F.col("all")).alias("justification"))


def parse_answer(raw: Column) -> Column:
    """OUI, NON or AMBIGU from a raw answer; AMBIGU when none is recognised."""
    up = F.upper(raw)
    label = F.lit("AMBIGU")
    for name in reversed(K.ANSWERS):
        label = F.when(up.contains(f"LABEL: {name}") | F.ltrim(up).startswith(name), F.lit(name)).otherwise(label)
    return label


def with_pair(df: DataFrame, raw: str) -> DataFrame:
    """Class (first line after ': ') and justification (rest after ': ') of a two-part answer."""
    lines = F.split(F.trim(F.col(raw)), "\n")
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " ")
    label = F.lower(F.trim(F.get(F.split(F.get(lines, F.lit(0)), ": "), F.lit(1))))
    with_rest = df.withColumn("__rest", rest).withColumn("classification", label)
    reason = F.when(F.col("__rest").contains(": "), F.trim(F.expr("substring(__rest, instr(__rest, ': ') + 2)")))
    return with_rest.withColumn("justification", reason).drop("__rest")


def prompt(text: Column, instruction: str = K.INSTRUCTION) -> Column:
    return F.concat(F.lit(instruction + "\nTexte:\n"), text)


Scorer = Callable[[pd.Series], pd.Series]


def keyword_scorer(yes: tuple[str, ...], no: tuple[str, ...]) -> Scorer:
    """Deterministic stand-in for a model: answers by the keywords a text holds."""

    def score(texts: pd.Series) -> pd.Series:
        low = texts.str.lower()
        has = lambda words: low.str.contains("|".join(map(re.escape, words)), na=False) if words else pd.Series(False, index=texts.index)
        answer = pd.Series("LABEL: AMBIGU\nJUSTIF: rien", index=texts.index)
        answer[has(no)] = "LABEL: NON\nJUSTIF: negation"
        answer[has(yes)] = "LABEL: OUI\nJUSTIF: mention"
        return answer

    return score


# Text handed to a model in one call; a longer text goes alone.
CALL_BYTES = 1 << 20


def calls(batch: pa.RecordBatch, text: str, most: int = CALL_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of at most ``most`` bytes of text."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if held + size > most and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def infer(df: DataFrame, keys: list[str], text: str, scorer: Scorer, attempts: int = 5) -> DataFrame:
    """Run a labelling model on every text, some texts a call, so that a worker holds few of them as Python strings whatever the number and length of
    texts in an Arrow batch; failed calls are retried inside the task. Keys are passed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in calls(batch, text):
                for attempt in range(attempts):
                    try:
                        raw = scorer(part.column(text).to_pandas().rename(text))
                        break
                    except Exception:
                        if attempt == attempts - 1:
                            raise
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(raw, pa.string(), from_pandas=True)], [*keys, "raw"])

    slim = df.select(*keys, text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name in keys) + ", raw string"
    return slim.mapInArrow(run, schema).withColumn("prediction", parse_answer(F.col("raw")))


# Largest top-k Spark cuts inside each task before the shuffle (its default threshold).
TASK_TOP_K = 1000


def class_sample(df: DataFrame, label: str, key: str, total: int) -> DataFrame:
    """At most ``total / 3`` rows of each class, in hash order of the key. A small sample is cut inside each task, a large
    one by distributed ranks."""
    k = total // 3
    if k <= TASK_TOP_K:
        hashed = df.withColumn("__md5", F.md5(F.col(key).cast("string")))
        return top_per_group(hashed, [label], [F.col("__md5"), F.col(key)], k).drop("rank", "__md5")
    return rank_in_hash_order(df, [label], key).where(F.col("rank") <= k).drop("rank", "group_size")
