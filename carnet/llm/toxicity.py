"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Fit. A token is a run of ASCII letters or non-ASCII characters, A-Z in lower case. A feature is a whole token or the stem of a longer one (its
first 5 or 7 characters, written with a star). Each token counts once per document: over all documents for the prior, over the labelled
training rows by label. With a Dirichlet prior proportional to the counts of the whole corpus, each feature gets the log ratio of its
rates in toxic and clean rows, and the z-score of that ratio. All features of at least ``min_z`` form the lexicon; they stand in labelled rows, whose number is
bounded, so the lexicon does not grow with the corpus. A token takes the score of its longest feature there, and all others share one small negative score.

Scan. A linear-time pass over the scores of a text finds all maximal-scoring segments. The scores are log-likelihood ratios, so
by construction the decay of the extreme-value law is 1, and a segment of score s in a text of n tokens is expected K n exp(-s) times by
chance. K is fitted on the segments of the clean training rows. A segment expected less than ``alpha`` times is a significant passage. The
evidence of a document is the sum of ln(1 / expected) over its segments expected less than once, and a logistic curve fitted on the
training rows turns it into a score.

The classifier is fitted on at most ``max_labels`` labelled rows (by hash of the id); the counts of the prior cover all documents.

Defined cases: null texts are empty; empty texts have no passages and get the score of no evidence; several labels of one document
count as toxic if one is; null labels are no labels; without labels of both kinds the lexicon is empty and every score is the share of toxic labels
(0 without labels). Neither labels nor any column but the text enters a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.llm.common import lower_ascii, text_bytes
from carnet.session import cut_lineage

RESULT = "struct<score: double, n_tokens: long, evidence: double, passages: array<struct<first: long, last: long, score: double, expected: double>>>"
_PASSAGE = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
_RESULT = pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("evidence", pa.float64()), ("passages", pa.list_(_PASSAGE))])

#: Bytes of tokens stay, capitals become small, all others become blanks.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Evidence beyond this says nothing more; histogram cells of evidence per unit.
MOST, CELLS = 60.0, 4
STEMS = (5, 7)


@dataclass(frozen=True)
class Settings:
    """Parameters of the fit."""

    prior: float = 0.1  # weight of the prior, as a share of the labelled tokens
    min_z: float = 3.0
    max_labels: int = 200_000
    alpha: float = 0.01
    floor: float = 1.0


def tokens(text: Column) -> Column:
    """Tokens of a text in SQL, equal to what the scan sees."""
    return F.filter(F.split(lower_ascii(text), r"[\x00-\x60\x7B-\x7F]+"), lambda t: t != "")


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) in linear time. Only runs of positive scores are visited one by one."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    total = np.concatenate(([0.0], np.cumsum(scores)))
    starts, ends = edge[::2].tolist(), edge[1::2].tolist()
    before, after = total[edge[::2]].tolist(), total[edge[1::2]].tolist()
    # Stack of candidates: first, end, sum before, sum after, index of the nearest earlier candidate with a smaller sum before.
    stack: list[tuple[int, int, float, float, int]] = []
    for first, end, low, high in zip(starts, ends, before, after):
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][2] >= low:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= high:
                stack.append((first, end, low, high, at))
                break
            first, low, link = stack[at][0], stack[at][2], stack[at][4]
            del stack[at:]
            at = link
    return [(first, end - 1, high - low) for first, end, low, high, _ in stack]


class _Scores(dict):
    """Token -> score. Tokens not in the lexicon take the score of a stem, or the common one; answers are kept, up to ``KEEP``."""

    KEEP = 200_000

    def __init__(self, lexicon: dict[str, float], other: float):
        super().__init__({k.encode(): v for k, v in lexicon.items() if not k.endswith("*")})
        self.lexicon, self.other, self.room = lexicon, other, self.KEEP

    def __missing__(self, token: bytes) -> float:
        word = token.decode("utf-8", "replace")
        found = next((self.lexicon[s] for s in stems(word) if s in self.lexicon), self.other)
        if self.room:
            self.room -= 1
            self[token] = found
        return found

    def __reduce__(self):
        return _Scores, (self.lexicon, self.other)


def stems(word: str) -> list[str]:
    """Stem features of a token, longest first."""
    return [word[:n] + "*" for n in sorted(STEMS, reverse=True) if len(word) > n]


def common_score(lexicon: dict[str, tuple[float, float, float]]) -> float:
    """Log ratio of meeting no lexicon feature, from (score, toxic rate, clean rate); features under another feature's stem add nothing."""
    free = [v for k, v in lexicon.items() if not any(s in lexicon and s != k for s in stems(k.rstrip("*") + ("~" if k.endswith("*") else "")))]
    p1, p0 = min(0.5, sum(v[1] for v in free)), min(0.5, sum(v[2] for v in free))
    return min(math.log((1 - p1) / (1 - p0)), -0.01)


@dataclass(frozen=True)
class Model:
    """A fitted model; ``scores`` holds the lexicon."""

    scores: _Scores
    chance: float  # K
    intercept: float
    slope: float
    settings: Settings

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        words = text.translate(_NORMAL).split()
        if not self.scores.lexicon or not words:
            return len(words), []
        return len(words), segments(np.fromiter(map(self.scores.__getitem__, words), np.float64, len(words)))

    def judge(self, text: bytes) -> dict:
        n, found = self.scan(text)
        evidence, passages = 0.0, []
        for first, last, score in found:
            rare = score - math.log(self.chance * n)  # ln(1 / expected)
            if rare > -math.log(self.settings.alpha):
                passages.append({"first": first, "last": last, "score": score, "expected": math.exp(-rare)})
            evidence += max(rare, 0.0)
        evidence = min(evidence, MOST)
        return {"score": 1 / (1 + math.exp(-(self.intercept + self.slope * evidence))), "n_tokens": n, "evidence": evidence, "passages": passages}


def logistic(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of P(toxic) by evidence, from (evidence, clean, toxic) counts; a weak prior keeps them finite."""
    x, n0, n1 = (np.array(c, float) for c in zip(*cells))
    w = np.array([math.log((n1.sum() + 0.5) / (n0.sum() + 0.5)), 0.0])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n1 - (n0 + n1) * p) - 1e-3 * w
        hessian = (design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, train: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit on the labelled rows for which ``train`` (a condition on ``doc_id``) holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(train)
    marks = cut_lineage(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = -(-marks.count() // settings.max_labels)
    if share > 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    marked = rows.join(F.broadcast(marks), "doc_id", "left")
    toxic_rows, clean_rows = marked.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not toxic_rows or not clean_rows:
        base = toxic_rows / max(1, toxic_rows + clean_rows)
        return Model(_Scores({}, 0.0), 1.0, 700.0 if base else -700.0, 0.0, settings)
    held = marked.select("toxic", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    words = cut_lineage(held.groupBy("token").agg(F.count("*").alias("y"), F.count_if(F.col("toxic") == 1).alias("y1"), F.count_if(F.col("toxic") == 0).alias("y0")))
    n, n1, n0 = words.agg(F.sum("y"), F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        n, n1, n0 = max(n or 0, 1), n1 or 0, n0 or 0
    features = F.filter(F.array(F.col("token"), *[F.when(F.length("token") > k, F.concat(F.substring("token", 1, k), F.lit("*"))) for k in STEMS]), lambda f: f.isNotNull())
    counts = words.select(F.explode(features).alias("feature"), "y", "y1", "y0").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("y", "y1", "y0")]).where("y1 + y0 > 0")
    weight = settings.prior * (n1 + n0)
    a = F.lit(weight) * F.col("y") / F.lit(float(n))
    p1, p0 = (F.col("y1") + a) / F.lit(n1 + weight), (F.col("y0") + a) / F.lit(n0 + weight)
    counts = counts.select("feature", p1.alias("p1"), p0.alias("p0"), F.log(p1 / p0).alias("score"), (F.log(p1 / p0) / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))).alias("z"))
    chosen = counts.where(F.abs("z") >= settings.min_z).orderBy("feature").collect()
    lexicon = {r["feature"]: (r["score"], r["p1"], r["p0"]) for r in chosen}
    scores = _Scores({k: v[0] for k, v in lexicon.items()}, common_score(lexicon))
    draft = spark.sparkContext.broadcast(Model(scores, 1.0, 0.0, 0.0, settings))

    @F.arrow_udf("struct<n: long, scores: array<double>>")
    def scan(texts: pa.Array) -> pa.Array:
        found = [draft.value.scan(t.as_py()) for t in texts]
        return pa.array([{"n": k, "scores": [s for *_, s in segs]} for k, segs in found], pa.struct([("n", pa.int64()), ("scores", pa.list_(pa.float64()))]))

    scanned = rows.join(F.broadcast(marks), "doc_id").select("toxic", scan.asNondeterministic()(text_bytes(F.col("text"))).alias("s")).select("toxic", "s.*")
    scanned = cut_lineage(scanned)
    seen, size = scanned.where("toxic = 0").agg(F.sum(F.size(F.filter("scores", lambda s: s >= settings.floor))), F.sum("n")).first()
    chance = ((seen or 0) + 0.5) * math.exp(settings.floor) / max(1, size or 0)
    usual = F.log(F.lit(chance) * F.col("n"))
    evidence = F.least(F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.greatest(s - usual, F.lit(0.0))), F.lit(MOST))
    cells = scanned.groupBy((F.round(evidence * CELLS) / CELLS).alias("x")).agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).orderBy("x").collect()
    intercept, slope = logistic([tuple(r) for r in cells])
    return Model(scores, chance, intercept, slope, settings)


def score(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """The documents with column ``out`` (``RESULT``): score, tokens, evidence and the significant passages, by token number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.judge(t.as_py()) for t in texts], _RESULT)

    return docs.withColumn(out, judge.asNondeterministic()(text_bytes(F.col(text))))
