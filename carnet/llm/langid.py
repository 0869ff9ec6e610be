"""Language identification by error-correcting output codes over character n-grams.

Codes. Every learned language has a codeword; bit k of the code splits the languages in two. Up to six languages get the exhaustive code (all splits, any
two codewords differ in half of the bits and more), more of them random balanced splits, of several draws the one whose nearest codewords are
farthest apart.

Classifiers. One per bit: a linear score over hashed n-grams of two to four bytes of the normalised text (lower case, other ASCII characters than letters
as one blank), with the log ratio of the n-gram's rates on both sides of the split, languages weighing alike, smoothed. The sum over a text, divided by
the root of its number of n-grams, goes through a logistic curve (no evidence: one half) whose slope is fitted on a part of the training sample that the
counts did not see. What the bit gets wrong there weighs it.

Decoding. For each codeword the logistic losses of all bits are added by weight; the smallest loss wins, ties to the smaller name. The score is the winner's
share of exp(-loss); below ``sure``, or where the runner-up comes within ``gap`` of the loss, the answer is flagged as ambiguous.

Sample. Fitted on at most about ``sample_rows`` labelled rows, the same number of each language where there are as many, chosen by a hash of the text;
whole texts of these. Weights are integers, so a score does not depend on how rows are dealt into tasks. The table of weights has at most ``cells``
cells: beyond that many (n-gram, language) pairs, n-grams share buckets.

Defined cases: texts that are null or have no letter are ``und`` with score 0, not ambiguous; so is every text if nothing was learned; with one language
every other text is that one, score 1; rows without a language teach nothing; repeated rows teach as often as they stand there; a letter of an
unknown script says nothing. Only the text, and for fitting the language, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.session import cut_lineage

UNKNOWN = "und"
ORDERS = (2, 3, 4)
#: Log ratios are stored in units of 1 / UNIT; margins are counted in cells of 1 / CELLS and end at MOST.
UNIT, CELLS, MOST = 1024, 8, 12.0
#: Bytes of texts handled at once; a longer text is handled alone.
PIECE = 1 << 19
RESULT = "struct<lang: string, score: double, second: string, gap: double>"
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("second", pa.string()), ("gap", pa.float64())])
_CLASS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    """Parameters of fit and decoding."""

    sample_rows: int = 60_000
    buckets: int = 1 << 16
    cells: int = 1 << 24
    smooth: float = 0.5
    sure: float = 0.75
    gap: float = 1.0
    seed: int = 7


# --- codes -----------------------------------------------------------------------------------------------------------------------

def codebook(languages: int, seed: int = 7) -> np.ndarray:
    """Codewords (language, bit) of -1 and 1."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 6:  # the first language is always on the same side
        rows = [(0, *rest) for size in range(languages - 1) for rest in combinations(range(1, languages), size)]
        return np.array([[1 if i in side else -1 for side in rows] for i in range(languages)], np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, most = None, -1
    for _ in range(32):
        half = np.arange(languages) < languages // 2
        code = np.stack([np.where(rng.permutation(half), 1, -1) for _ in range(bits)], axis=1).astype(np.int8)
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        near = int(apart[~np.eye(languages, dtype=bool)].min())
        if near > most:
            best, most = code, near
    return best


# --- features --------------------------------------------------------------------------------------------------------------------

def has_letter(text: Column) -> Column:
    """Whether a text holds a letter of any script."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def prepared(text: Column) -> Column:
    """UTF-8 bytes of the lower-case text between two blanks."""
    return F.concat(F.lit(" "), F.lower(text), F.lit(" ")).cast("binary")


def _pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``PIECE`` bytes each; a longer text is a range of its own."""
    ends = np.cumsum(np.maximum(np.diff(_offsets(column)), 1))
    at = 0
    while at < len(column):
        start = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + PIECE, side="right")))
        yield at, to
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def grams(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a batch of prepared texts, by size and order of the n-grams: first and last row, bucket of every n-gram, and the row each belongs to
    (from the part's first on, ascending)."""
    offsets = _offsets(column)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    for first, last in _pieces(column):
        letters = _CLASS[data[offsets[first]:offsets[last]]]
        row = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(offsets[first:last + 1]))
        blank = letters == 32
        again = np.zeros(len(letters), bool)
        again[1:] = blank[1:] & blank[:-1] & (row[1:] == row[:-1])
        letters, row = letters[~again].astype(np.uint32), row[~again]
        code = letters
        for n in ORDERS:
            code = (code[:-1] << np.uint32(8)) | letters[n - 1:]
            inside = row[:len(code)] == row[n - 1:] if len(code) else np.zeros(0, bool)
            if inside.any():
                mixed = (code[inside] + np.uint32(n)) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
                yield first, last, ((mixed * np.uint32(0x85EBCA77)) >> np.uint32(8)) % np.uint32(buckets), row[:len(code)][inside]


def sums(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer sum of the weights of each text's n-grams per bit, and their number."""
    by_bit = np.ascontiguousarray(weights.T)
    total, count = np.zeros((len(column), len(by_bit)), np.int64), np.zeros(len(column), np.int64)
    for first, _, bucket, owner in grams(column, len(weights)):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = first + owner[starts]
        count[rows] += np.diff(starts, append=len(owner))
        for bit, row in enumerate(by_bit):
            total[rows, bit] += np.add.reduceat(row[bucket], starts, dtype=np.int64)
    return total, count


def margins(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the curves are fitted on."""
    return np.clip(total / (UNIT * np.sqrt(np.maximum(count, 1)))[:, None], -MOST, MOST)


# --- model -----------------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Languages, codewords, integer weights (bucket, bit), slopes of the curves and weights of the bits."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slopes: np.ndarray
    trust: np.ndarray
    settings: Settings

    def losses(self, margin: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword, per text."""
        logit = self.slopes * margin
        yes, no = np.logaddexp(0, -logit) * self.trust, np.logaddexp(0, logit) * self.trust
        return yes @ (self.code > 0).T + no @ (self.code < 0).T

    def decode(self, column: pa.Array) -> list[dict]:
        """Nearest codeword of each prepared text."""
        if len(self.languages) < 2:
            only = self.languages[0] if self.languages else UNKNOWN
            return [{"lang": only, "score": 1.0 if self.languages else 0.0, "second": None, "gap": None}] * len(column)
        loss = np.round(self.losses(margins(*sums(column, self.weights))), 9)
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = loss[np.arange(len(loss)), order[:, 0]], loss[np.arange(len(loss)), order[:, 1]]
        share = 1 / np.exp(best[:, None] - loss).sum(axis=1)
        return [{"lang": self.languages[a], "score": float(min(s, 1.0)), "second": self.languages[b], "gap": float(g)} for a, b, s, g in zip(order[:, 0], order[:, 1], share, second - best)]


def sampled(rows: DataFrame, sizes: dict[str, int], settings: Settings) -> DataFrame:
    """About the same number of rows of each language, by a hash of the text, and whether a row is for the curves (``later``)."""
    each = max(1, settings.sample_rows // len(sizes))
    units = 1 << 20
    at = F.pmod(F.xxhash64(F.col("text"), F.lit(settings.seed)), F.lit(units))
    limits = {lang: units * each // n for lang, n in sizes.items() if n > each}
    limit = F.lit(units)
    for lang, most in limits.items():
        limit = F.when(F.col("lang") == lang, F.lit(max(1, most))).otherwise(limit)
    return rows.where(at < limit).select("lang", prepared(F.col("text")).alias("bytes"), (F.pmod(F.xxhash64(F.col("text"), F.lit(settings.seed + 1)), F.lit(4)) == 0).alias("later"))


def fit(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """Fit on the rows of ``docs`` that have a language and a letter."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    code = codebook(len(languages), settings.seed)
    bits = code.shape[1]
    if not bits:
        return Model(languages, code, np.zeros((1, 0), np.int32), np.zeros(0), np.zeros(0), settings)
    buckets = settings.buckets
    while buckets > 256 and buckets * max(bits, len(languages)) > settings.cells:
        buckets //= 2
    number = {name: i for i, name in enumerate(languages)}
    sample = cut_lineage(sampled(rows, sizes, settings))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        for batch in batches:
            who = np.array([number[name] for name in batch.column("lang").to_pylist()], np.int64)
            for first, _, bucket, owner in grams(batch.column("bytes"), buckets):
                mine = who[first + owner]
                for i in np.unique(mine):
                    cells[int(i)] = cells.get(int(i), 0) + np.bincount(bucket[mine == i], minlength=buckets)
        for i, counts in cells.items():
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(np.full(len(met), i, np.int32)), pa.array(counts[met])], ["bucket", "lang", "n"])

    # A text of both parts stands in the counts only if no row is left for them.
    train = sample.where(~F.col("later"))
    train = sample if train.isEmpty() else train
    counted = train.select("lang", "bytes").mapInArrow(tally, "bucket int, lang int, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((buckets, len(languages)))
    table[counted["bucket"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy()
    rates = (table + settings.smooth) / (table.sum(axis=0) + settings.smooth * buckets)
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    weights = np.rint(UNIT * np.log((rates @ up / up.sum(axis=0)) / (rates @ down / down.sum(axis=0)))).astype(np.int32)
    weights[table.sum(axis=1) == 0] = 0  # what no language has says nothing
    slopes, trust = _curves(sample, code, weights, number)
    return Model(languages, code, weights, slopes, trust, settings)


def _curves(sample: DataFrame, code: np.ndarray, weights: np.ndarray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slope and weight of each bit, from counts of rounded margins; both sides weigh alike, and languages within a side."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.rint(margins(*sums(batch.column("bytes"), shared.value)) * CELLS).astype(np.int32)
                who = np.array([number[name] for name in batch.column("lang").to_pylist()], np.int32)
                rows, bits = at.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(bits, dtype=np.int32), rows)), pa.array(np.repeat(who, bits)), pa.array(at.ravel())], ["bit", "lang", "at"])

    later = sample.where("later")
    later = sample if later.isEmpty() else later
    seen = later.select("lang", "bytes").mapInArrow(measure, "bit int, lang int, at int").groupBy("bit", "lang", "at").agg(F.count("*").alias("n")).collect()
    bits = code.shape[1]
    slopes, trust, of_lang = np.zeros(bits), np.zeros(bits), np.zeros(len(code))
    for r in seen:
        of_lang[r["lang"]] += r["n"] if r["bit"] == 0 else 0
    for bit in range(bits):
        rows = np.array([(r["at"] / CELLS, code[r["lang"], bit], r["n"] / of_lang[r["lang"]]) for r in sorted(seen, key=lambda r: (r["at"], r["lang"])) if r["bit"] == bit])
        agreed, weight = rows[:, 0] * rows[:, 1], rows[:, 2]
        for side in (-1, 1):
            weight[rows[:, 1] == side] /= max(weight[rows[:, 1] == side].sum(), 1e-9)
        slopes[bit] = slope(agreed, weight / weight.sum())
        trust[bit] = max(0.05, 1 - 2 * weight[agreed <= 0].sum() / weight.sum())
    return slopes, trust


def slope(agreed: np.ndarray, weight: np.ndarray) -> float:
    """Slope of a logistic curve through the origin, from margins in the direction of the truth; a weak prior keeps it finite."""
    b, prior = 0.0, 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(b * agreed, -30, 30)))
        step = ((weight * agreed * p).sum() - prior * b) / ((weight * agreed ** 2 * p * (1 - p)).sum() + prior)
        b += float(np.clip(step, -1, 1))
        if abs(step) < 1e-9:
            break
    return max(b, 1e-3)


def identify(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """The documents with column ``out``: lang, score, second (the runner-up), gap (of the losses) and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def decode(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.decode(texts), _RESULT)

    letters = has_letter(F.col(text))
    found = decode.asNondeterministic()(F.when(letters, prepared(F.col(text))).otherwise(F.lit(b"")))
    known = F.when(letters, F.lit(bool(model.languages))).otherwise(F.lit(False))
    close = (F.col(f"{out}.score") < model.settings.sure) | (F.col(f"{out}.gap") < model.settings.gap)
    answer = F.struct(F.when(known, F.col(f"{out}.lang")).otherwise(UNKNOWN).alias("lang"), F.when(known, F.col(f"{out}.score")).otherwise(0.0).alias("score"),
                      F.when(known, F.col(f"{out}.second")).alias("second"), F.when(known, F.col(f"{out}.gap")).alias("gap"), (known & F.coalesce(close, F.lit(False))).alias("ambiguous"))
    return docs.withColumn(out, found).withColumn(out, answer)
