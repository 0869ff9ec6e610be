"""The nearest lexicon word of every word by edit score, exactly, without scoring all pairs.

Levels. Cut-offs from high to low are tried first by the piece join of ``suggest.fuzzy_pairs``: a word with a partner at a level has its best one there, and leaves.

Metric tree. The words left meet a tree over the lexicon (one level of vantage words, each lexicon word in the leaf of its nearest one). Edit distance is a
metric: for each leaf the least and greatest distance of its members to every vantage word are kept, so a word's distances to the vantage words bound
its distance to all members from below. With the lengths in the leaf this bounds the score from above: the leaf of the best bound is searched, then in one
pass every other one that can still hold a better word, or an equal one that sorts before.

Distances of a word to many lexicon words are computed at once, one machine word per lexicon word (the bit-parallel recurrence of Myers and Hyyrö).

A lexicon is cut into slices of bounded size; each slice's tree is built from distances that tasks compute, and broadcast. A word carries its best so far from
slice to slice, which prunes the next one.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnet.session import cut_lineage

# Workers get the tree with the task, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lexicon words and characters of a slice at most (about), longest word of one machine word.
SLICE_WORDS, SLICE_CHARS, BITS = 20_000, 1 << 20, 64
FOUND = "word string, score double, nearest string"


def plain_distance(a: str, b: str) -> int:
    """Edit distance by the table, for lexicon words longer than a machine word."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Words:
    """Lexicon words ready to be compared with one word at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.long = np.flatnonzero(self.lengths > BITS)
        places: dict[str, np.ndarray] = {}
        for at, word in enumerate(words):
            for i, char in enumerate(word[:BITS]):
                if char not in places:
                    places[char] = np.zeros(len(words), np.uint64)
                places[char][at] |= np.uint64(1 << i)
        self.places = places
        self.last = np.uint64(1) << (np.clip(self.lengths, 1, BITS) - 1).astype(np.uint64)

    def distances(self, word: str, rows: np.ndarray | None = None) -> np.ndarray:
        """Edit distances of ``word`` to the lexicon words ``rows`` (to all without it)."""
        rows = slice(None) if rows is None else rows
        one, last, score = np.uint64(1), self.last[rows], self.lengths[rows].copy()
        plus, minus = np.full(len(last), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(last), np.uint64)
        for char in word:
            held = self.places.get(char)
            x = (held[rows] | minus) if held is not None else minus
            diagonal = (((x & plus) + plus) ^ plus) | x
            down, up = plus & diagonal, minus | ~(plus | diagonal)
            score += (up & last) != 0
            score -= (down & last) != 0
            x = (up << one) | one
            minus = x & diagonal
            plus = (down << one) | ~(x | diagonal)
        for at in np.flatnonzero(self.lengths[rows] > BITS) if len(self.long) else ():
            score[at] = plain_distance(word, self.words[at if isinstance(rows, slice) else rows[at]])
        return score


def scores(distance: np.ndarray, length: int, lengths: np.ndarray) -> np.ndarray:
    """Rounded scores."""
    return np.round(100.0 * (1 - distance / np.maximum(length, lengths)), 2)


class Tree:
    """Vantage words, leaves, and the ranges of distances between them. ``words`` is sorted; ``to`` holds each word's distances to the vantage words."""

    def __init__(self, words: list[str], vantage: list[str], to: np.ndarray):
        leaf = to.argmin(axis=1)
        order = np.argsort(leaf, kind="stable")
        self.held, self.vantage = Words([words[i] for i in order]), Words(vantage)
        present, starts = np.unique(leaf[order], return_index=True)
        self.starts, self.ends = starts, np.append(starts[1:], len(words))
        self.low, self.high = np.minimum.reduceat(to[order], starts, axis=0), np.maximum.reduceat(to[order], starts, axis=0)
        self.short, self.tall = np.minimum.reduceat(self.held.lengths, starts), np.maximum.reduceat(self.held.lengths, starts)

    def nearest(self, word: str, score: float, best: str | None) -> tuple[float, str | None, int]:
        """Best score and word, given the best so far; also the number of distances computed."""
        n = len(word)
        seen = self.vantage.distances(word)
        least = np.maximum(np.maximum(self.low - seen, seen - self.high).max(axis=1), 0)
        least = np.maximum(least, np.maximum(self.short - n, n - self.tall))
        bound = np.round(100.0 * (1 - least / np.maximum(n, self.tall)), 2)
        score, best = self._better(word, seen, self.vantage, None, score, best)
        spent, todo = len(seen), bound >= score
        if todo.any():  # the most promising leaf, then whatever its result leaves open, in one pass
            leaf = int(bound.argmax())
            rows = np.arange(self.starts[leaf], self.ends[leaf])
            score, best = self._better(word, self.held.distances(word, rows), self.held, rows, score, best)
            spent, todo = spent + len(rows), bound >= score
            todo[leaf] = False
            size = int((self.ends - self.starts)[todo].sum())
            if size:
                # Picking words out costs more than passing over them.
                rows = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in np.flatnonzero(todo)]) if size < len(self.held.words) // 4 else None
                score, best = self._better(word, self.held.distances(word, rows), self.held, rows, score, best)
                spent += len(self.held.words) if rows is None else size
        return score, best, spent

    @staticmethod
    def _better(word: str, distance: np.ndarray, held: Words, rows: np.ndarray | None, score: float, best: str | None) -> tuple[float, str | None]:
        """Best of what was found and the best so far; ties go to the word that sorts first."""
        found = scores(distance, len(word), held.lengths if rows is None else held.lengths[rows])
        top = float(found.max())
        if top < score:
            return score, best
        at = np.flatnonzero(found == top)
        first = min(held.words[r] for r in (at if rows is None else rows[at]))
        return top, first if top > score or best is None else min(best, first)


def _slices(lexicon: DataFrame, words: int, chars: int) -> Iterator[Tree]:
    """Trees of the slices of a stored lexicon (column ``lex``, distinct), dealt by hash. Tasks compute the distances to a slice's vantage words."""
    n, size = lexicon.agg(F.count("*"), F.sum(F.length("lex"))).first()
    parts = max(1, math.ceil(n / words), math.ceil((size or 0) / chars))
    for part in range(parts if n else 0):
        mine = lexicon.where(F.pmod(F.xxhash64("lex"), F.lit(parts)) == part)
        count = mine.count()
        if not count:
            continue
        vantage = [r["lex"] for r in mine.orderBy(F.xxhash64("lex", F.lit(1)), "lex").limit(math.isqrt(count - 1) + 1).collect()]
        held = Words(vantage)

        def measure(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [held.distances(w).tolist() for w in batch.column("lex").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("lex"), pa.array(found, pa.list_(pa.int32()))], ["lex", "to"])

        rows = mine.select("lex").repartition(lexicon.sparkSession.sparkContext.defaultParallelism, "lex").mapInArrow(measure, "lex string, to array<int>").orderBy("lex").toArrow()
        to = rows.column("to").combine_chunks().flatten().to_numpy().reshape(-1, len(vantage)).astype(np.int64)
        yield Tree(rows.column("lex").to_pylist(), vantage, to)


def nearest_words(words: DataFrame, lexicon: DataFrame, cutoff: float = 0, levels: tuple[int, ...] = (80,), slice_words: int = SLICE_WORDS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Rows (word, nearest, score): the best lexicon word (``lex``) of every distinct word that scores at least ``cutoff``; ties by code-point order. Empty words
    have none."""
    from carnet.operators.suggest import fuzzy_pairs

    spark = words.sparkSession
    lexicon = cut_lineage(lexicon.select("lex").where("lex <> ''").distinct())
    left = cut_lineage(words.select("word").where("word <> ''").distinct())
    done = None
    for level in sorted((v for v in levels if v > cutoff), reverse=True):
        pairs = fuzzy_pairs(left, lexicon, "word", "lex", level)
        best = cut_lineage(pairs.groupBy("word").agg(F.min(F.struct((-F.col("score")).alias("k"), "lex")).alias("b")).select("word", (-F.col("b.k")).alias("score"), F.col("b.lex").alias("nearest")))
        done = best if done is None else done.unionByName(best)
        left = cut_lineage(left.join(best, "word", "left_anti"))
    rows = left.select("word", F.lit(float(cutoff)).alias("score"), F.lit(None).cast("string").alias("nearest")).repartition(4 * spark.sparkContext.defaultParallelism, "word")
    for nth, tree in enumerate(_slices(lexicon, slice_words, slice_chars)):
        shared = spark.sparkContext.broadcast(tree)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shared.value.nearest(w, s, b) for w, s, b in zip(*(batch.column(c).to_pylist() for c in ("word", "score", "nearest")))]
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string())], ["word", "score", "nearest"])

        rows = rows.mapInArrow(search, FOUND)
        rows = cut_lineage(rows)
    rows = rows.where("nearest IS NOT NULL")
    out = rows if done is None else rows.unionByName(done.select(*rows.columns))
    return out.select("word", "nearest", "score")
