"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (runs of anything but ASCII white space, A-Z in lower case), then one end. The probability of a token is that of its class given
the context, times that of the word inside its class. Classes: the most frequent tokens have one each, the end has one, and all other words,
known or not, are classed by a hash of their last two bytes. The class softmax sums hashed feature weights: the word before, the one before that,
the one three back (skips), and the pair before (n-gram), ``width`` rows per kind. Inside a class, a word seen c times in the training
texts has share c + 1, and one further share is that of all unseen words.

Training. Word counts cover all training texts. The weights are fitted in ``rounds`` distributed gradient updates: each takes its own part
of the training documents, every task sums the gradient over its texts in numpy, block sums are added by key, and the driver takes a damped
Newton step with the diagonal of the curvature. Every training text counts in one update; nothing is sampled.

Scoring. Texts are scored in sparse numpy batches. The counts of the ``table`` most frequent words are broadcast (a bounded table); the
other words of a text leave the task as a list and meet the full count table by a join, so the vocabulary may have any size.

Defined cases: a null text is empty and has the end as its only token; repeated rows and null ids are scored row by row (a null id is in
fold 0, so it trains); without training texts all classes are equally likely. Only the id and the text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.llm.common import lower_ascii, text_bytes
from carnet.session import cut_lineage

#: The end of a text; no word can hold a blank.
END = " "
TOP, SHAPES = 23, 24
CLASSES = TOP + 1 + SHAPES
KINDS = 4
BLOCKS = 16
#: Tokens worked on at once, and splits of the table that one gradient task takes.
CHUNK, SPLITS = 32_768, 4


@dataclass(frozen=True)
class Settings:
    """Parameters of the model."""

    width: int = 2_048
    rounds: int = 4
    step: float = 0.4
    damping: float = 20.0
    table: int = 200_000


def shape(word: Column) -> Column:
    """Class of a word that has none of its own."""
    return (F.lit(TOP + 1) + F.crc32(F.substring(word.cast("binary"), -2, 2)) % SHAPES).cast("int")


class _Logs(dict):
    """Frequent word -> log10(count + 1); -1 for all others."""

    def __missing__(self, word: bytes) -> float:
        return -1.0


# Words are found and hashed in a byte array: ASCII white space divides, and the hash of a word is a polynomial in its bytes modulo 2^64.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHAPE2 = np.array([zlib.crc32(bytes((i >> 8, i & 255))) % SHAPES for i in range(1 << 16)], np.int64)
_SHAPE1 = np.array([zlib.crc32(bytes((i,))) % SHAPES for i in range(256)], np.int64)
#: Bytes hashed at once.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PIECE + 2), _powers(_INVERSE, PIECE + 2)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, hashes and shape classes of all words of a lower-case text."""
    a = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[a], [True])).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    hashes = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        # As many words as fit in a piece, or one longer word alone.
        upto = max(at + 1, int(np.searchsorted(end, first[at] + PIECE, "right")))
        lo, hi = int(first[at]), int(end[upto - 1])
        up, down = (_UP, _DOWN) if hi - lo <= PIECE else (_powers(_BASE, hi - lo + 1), _powers(_INVERSE, hi - lo + 1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], dtype=np.uint64)))
        hashes[at:upto] = (sums[end[at:upto] - lo] - sums[first[at:upto] - lo]) * down[first[at:upto] - lo]
        at = upto
    last = a[end - 1].astype(np.int64)
    shapes = np.where(end - first > 1, _SHAPE2[(a[np.maximum(end - 2, 0)].astype(np.int64) << 8) | last], _SHAPE1[last])
    return end, hashes, shapes + TOP + 1


class Coder:
    """Classes and hashes of tokens, given the words that have a class of their own."""

    def __init__(self, top: list[bytes]):
        own = np.array([word_hashes(w)[1][0] for w in top], np.uint64)
        self.order = np.argsort(own)
        self.own = own[self.order]

    def batches(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of texts of about ``PIECE`` bytes: number of texts, classes and hashes of all tokens with an end per text, start of each text."""
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(text.lower())
            size += len(text) + 1
            if size >= PIECE or i + 1 == len(texts):
                end, hashes, shapes = word_hashes(b"\n".join(group))
                if len(self.own):
                    at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
                    shapes = np.where(self.own[at] == hashes, self.order[at], shapes)
                borders = np.cumsum([len(t) + 1 for t in group])
                owner = np.searchsorted(borders, end, "left")
                counts = np.bincount(owner, minlength=len(group)) + 1
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                cls, word = np.full(counts.sum(), TOP, np.int64), np.full(counts.sum(), 1, np.uint64)
                place = np.arange(len(hashes)) + owner
                cls[place], word[place] = shapes, hashes
                yield len(group), cls, word, starts
                group, size = [], 0


def features(word: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Rows of the weight matrix that speak for each token, one per kind; before a text stands nothing (hash 0)."""
    place = np.arange(len(word)) - np.repeat(starts, np.diff(np.append(starts, len(word))))
    back = []
    for k in (1, 2, 3):
        moved = np.zeros_like(word)
        moved[k:] = word[:-k]
        moved[place < k] = 0
        back.append(moved)
    pair = (back[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (back[1] * np.uint64(0xC2B2AE3D27D4EB4F))
    kinds = [h ^ (h >> np.uint64(29)) for h in (*back, pair)]
    return np.stack([((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(width) + np.uint64(i * width) for i, h in enumerate(kinds)]).astype(np.int64)


def class_sums(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the weights of all classes for the tokens with these feature rows; the last weight row is the bias. Steps are clipped in
    training, so exponentials of the sums are finite."""
    z = np.take(weights, rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, mode="clip")
    z += weights[-1]
    return z


def class_logs(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of all classes."""
    z = class_sums(weights, rows)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def add_gradient(total: np.ndarray, weights: np.ndarray, cls: np.ndarray, rows: np.ndarray) -> None:
    """Add the log-likelihood gradient of the tokens to ``total``, whose last column counts the tokens of a row."""
    width = (len(weights) - 1) // KINDS
    for at in range(0, len(cls), CHUNK):
        part = rows[:, at:at + CHUNK]
        miss = np.exp(class_sums(weights, part))
        miss /= -miss.sum(axis=1, keepdims=True)
        miss[np.arange(len(miss)), cls[at:at + CHUNK]] += 1
        total[-1, :-1] += miss.sum(axis=0, dtype=np.float64)
        total[-1, -1] += len(miss)
        for r in part:
            order = np.argsort((r % width).astype(np.uint16 if width <= 1 << 16 else np.uint32), kind="stable")
            first = np.flatnonzero(np.diff(r[order], prepend=-1))
            met = r[order[first]]
            total[met, :-1] += np.add.reduceat(miss[order], first, axis=0)
            total[met, -1] += np.diff(np.append(first, len(r)))


@dataclass
class Model:
    """A trained model. ``counts`` (word, c) stays a table; everything else is bounded."""

    counts: DataFrame
    n: int
    v: int
    top: list[bytes]
    weights: np.ndarray
    mass: np.ndarray
    logs: dict[bytes, float]
    settings: Settings


def _summed(key, table):
    """Sum of the gradient blocks of one key."""
    total = sum(np.frombuffer(b.as_py(), np.float32).astype(np.float64) for b in table.column("part"))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": [total.tobytes()]})


def gradient(texts: DataFrame, weights: np.ndarray, top: list[bytes], settings: Settings) -> np.ndarray:
    """Gradient over all texts. Each task sums over a few splits of the table and gives one sum, in blocks."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((weights, top))

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = shared.value
        coder = Coder(words)
        total = np.zeros((len(held), CLASSES + 1), np.float64)
        for batch in arrived:
            for _, cls, word, starts in coder.batches(batch.column("text").to_pylist()):
                add_gradient(total, held, cls, features(word, starts, settings.width))
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "part": pa.array([b.tobytes() for b in np.array_split(total.ravel().astype(np.float32), BLOCKS)], pa.binary())})

    tasks = texts.coalesce(max(1, spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // SPLITS)).mapInArrow(run, "block int, part binary")
    blocks = tasks.groupBy("block").applyInArrow(_summed, "block int, part binary").orderBy("block").collect()
    flat = np.concatenate([np.frombuffer(bytes(b["part"]), np.float64) for b in blocks]) if blocks else np.zeros(len(weights) * (CLASSES + 1))
    return flat.reshape(len(weights), CLASSES + 1)


def train(docs: DataFrame, text: str = "text", part: Column | None = None, settings: Settings = Settings()) -> Model:
    """Train on all documents. ``part`` deals them to the rounds (an expression that gives a whole number)."""
    texts = docs.select(text_bytes(F.col(text)).alias("text"), (F.lit(0) if part is None else F.pmod(part, F.lit(settings.rounds))).alias("round"))
    words = docs.select(F.explode(F.split(lower_ascii(F.col(text)), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counts = cut_lineage(words.groupBy("word").agg(F.count("*").alias("c")))
    ends = docs.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    frequent = counts.orderBy(F.col("c").desc(), "word").limit(settings.table).toArrow().to_pydict()
    top = [w.encode() for w in frequent["word"][:TOP]]
    own = F.create_map(*[x for i, w in enumerate(frequent["word"][:TOP]) for x in (F.lit(w), F.lit(i))]) if top else None
    group = shape(F.col("word")) if own is None else F.coalesce(F.element_at(own, F.col("word")), shape(F.col("word")))
    mass = np.ones(CLASSES)
    mass[:len(top)] = 0
    for cls, m in counts.groupBy(group.alias("k")).agg(F.sum(F.col("c") + 1)).collect():
        mass[cls] += m
    mass[TOP] = ends + 1
    mass[len(top):TOP] = 1e-9  # classes that no token has
    weights = np.zeros((KINDS * settings.width + 1, CLASSES), np.float32)
    share = mass / mass.sum()
    weights[-1] = np.log(share)
    for k in range(settings.rounds if ends else 0):
        g = gradient(texts.where(F.col("round") == k).select("text"), weights, top, settings)
        seen = g[:, -1:]
        step = settings.step * g[:, :-1] / (seen * share * (1 - share) + settings.damping * np.sqrt(share))
        step[-1] = 0  # the bias is known from the counts
        weights = (weights + np.clip(step, -1.5, 1.5)).astype(np.float32)
    logs = {w.encode(): math.log10(c + 1) for w, c in zip(frequent["word"], frequent["c"])}
    return Model(counts, n, v, top, weights, mass, logs, settings)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: the columns ``keep``, n_tokens, n_known, base_score (unigrams with one added) and score (the model's), log10 of
    the text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.top, np.log10(model.mass), model.logs, math.log10(model.mass[TOP]), model.settings.width))

    @F.arrow_udf("struct<seen: long, known: long, logs: double, fixed: double, rare: array<string>>")
    def measure(texts: pa.Array) -> pa.Array:
        weights, top, mass, logs, end, width = shared.value
        known, out = _Logs(logs), []
        raw = [t.as_py() for t in texts]
        for n, cls, word, starts in Coder(top).batches(raw):
            rows = features(word, starts, width)
            each = np.empty(len(cls))
            for at in range(0, len(cls), CHUNK):
                z = class_sums(weights, rows[:, at:at + CHUNK])
                each[at:at + CHUNK] = z[np.arange(len(z)), cls[at:at + CHUNK]] - np.log(np.exp(z, out=z).sum(axis=1))
            fixed = np.add.reduceat(each / math.log(10) - mass[cls], starts)
            for text, value in zip(raw[len(out):len(out) + n], fixed.tolist()):
                words = text.lower().split()
                found = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                rare = np.flatnonzero(found < 0).tolist()
                out.append({"seen": len(words) + 1, "known": len(words) - len(rare), "logs": float(found[found >= 0].sum()) + end, "fixed": value, "rare": [words[i].decode("utf-8", "replace") for i in rare]})
        return pa.array(out, pa.struct([("seen", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("fixed", pa.float64()), ("rare", pa.list_(pa.string()))]))

    kept = docs.select(F.struct(*keep).alias("row"), measure.asNondeterministic()(text_bytes(F.col(text))).alias("m"))
    # Stored once, so that the row number is the same wherever it is read.
    kept = cut_lineage(kept).withColumn("nth", F.monotonically_increasing_id())
    asked = kept.select("nth", F.explode("m.rare").alias("word"))
    rare = asked.join(model.counts, "word").groupBy("nth").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("n"))
    joined = kept.join(rare, "nth", "left")
    logs = F.col("m.logs") + F.coalesce("more", F.lit(0.0))
    ends = 1 if model.n else 0
    return joined.select("row.*", F.col("m.seen").alias("n_tokens"), (F.col("m.known") + F.coalesce("n", F.lit(0)) + ends).alias("n_known"),
                         (logs - F.col("m.seen") * F.lit(math.log10(model.n + model.v + 1))).alias("base_score"), (logs + F.col("m.fixed")).alias("score"))
