"""Language model and neighbours against brute force, the pipeline's stages, and every registered query on the smallest tables."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from carnet import llm
from carnet.llm import langmodel, neighbours


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, sf_dir, name):
    reason, rows, _, _ = oracle.run_one(spark, oracle.connect(sf_dir), name, llm.QUERIES[name], llm.ORACLES.get(name), sf_dir)
    assert reason is None and rows > 0


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def test_language_model(spark):
    rows = [(i, f"the cat{i % 50} sat on the mat and the dog{i % 9} ran " * (1 + i % 3)) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "Été \x0b THE unknownword " * 4000), (None, "the end"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    train = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    settings = langmodel.Settings(width=256, table=20)
    model = langmodel.train(docs.where(train), part=F.xxhash64("doc_id"), settings=settings)
    counts = collections.Counter(w for i, t in rows if i is None or i % 5 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert (model.n, model.v) == (n, v)
    got = langmodel.score(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    plain = collections.Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        plain[i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(base, 5)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == plain
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 5 == 0 and r["doc_id"] < 300]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_model_is_a_distribution(spark):
    """Over all known words, the end and one unseen word, the probabilities of the next token add up to one."""
    rows = [(i, f"a{i % 4} b{i % 6} c{i % 30}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = langmodel.train(docs, part=F.col("doc_id"), settings=langmodel.Settings(width=64, table=5))
    coder = langmodel.Coder(model.top)
    _, _, word, starts = next(coder.batches([b"a1 b1 c1"]))
    logs = langmodel.class_logs(model.weights, langmodel.features(word, starts, 64))[2]
    counts = {r["word"].encode(): r["c"] for r in model.counts.collect()}
    own = {w: int(next(coder.batches([w]))[1][0]) for w in counts}
    total = sum(math.exp(logs[own[w]]) * (c + 1) / model.mass[own[w]] for w, c in counts.items()) + math.exp(logs[langmodel.TOP])
    unseen = sum(math.exp(logs[k]) / model.mass[k] for k in range(langmodel.TOP + 1, langmodel.CLASSES))
    assert abs(total + unseen - 1) < 1e-6


def test_the_23_most_frequent_words_have_classes_of_their_own():
    """The softmax chooses among 48 classes: 23 words, the end, 24 groups of all other words."""
    words = [b"w%d" % i for i in range(23)]
    _, cls, _, _ = next(langmodel.Coder(words[:langmodel.TOP]).batches([b" ".join(words)]))
    assert cls[:-1].tolist() == list(range(23)) and langmodel.CLASSES == 48


def test_words_are_found_and_hashed_alike_everywhere():
    rng = np.random.default_rng(2)
    texts = [b"", b" ", b"a", b"\xc3\xa9 ab\x0b\x1cc  d\r\n", b"x" * (langmodel.PIECE + 5) + b" y x", b"end ", b" lead"]
    texts += [bytes(rng.choice(list(b"ab c\n\xff\x00"), 200).astype(np.uint8)) for _ in range(40)]
    coder = langmodel.Coder([b"ab"])
    seen = {}
    at = 0
    for n, cls, word, starts in coder.batches(texts):
        ends = [*starts[1:], len(cls)]
        for text, lo, hi in zip(texts[at:at + n], starts, ends):
            words = text.lower().split()
            assert hi - lo == len(words) + 1 and cls[hi - 1] == langmodel.TOP
            for w, c, h in zip(words, cls[lo:hi], word[lo:hi]):
                assert seen.setdefault(w, (c, h)) == (c, h)
                assert c == (0 if w == b"ab" else langmodel.TOP + 1 + zlib.crc32(w[-2:]) % langmodel.SHAPES)
        at += n
    assert at == len(texts) and len({h for _, h in seen.values()}) == len(seen)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    cls = rng.integers(0, langmodel.CLASSES, 300)
    rows = langmodel.features(rng.integers(0, 99, 300).astype(np.uint64), np.array([0, 100]), 16)
    weights = rng.normal(size=(65, langmodel.CLASSES)) * 0.3

    def likelihood(w):
        return langmodel.class_logs(w, rows)[np.arange(300), cls].sum()

    total = np.zeros((65, langmodel.CLASSES + 1))
    langmodel.add_gradient(total, weights, cls, rows)
    for _ in range(20):
        i, j = rng.integers(0, 65), rng.integers(0, langmodel.CLASSES)
        moved = weights.copy()
        moved[i, j] += 1e-5
        assert abs((likelihood(moved) - likelihood(weights)) / 1e-5 - total[i, j]) < 1e-2


def test_language_model_without_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = langmodel.train(docs.limit(0))
    rows = langmodel.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == 2 and all(r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert langmodel.score(docs.limit(0), model, ["doc_id"]).count() == 0


def brute(rows, k, every):
    """Nearest rows by definition, one per id and vector."""
    dims = max((len(v) for _, v in rows if v), default=0)
    good = {(i, tuple(v) + (0.0,) * (dims - len(v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, v in good:
        if i % every == 0:
            near = sorted((math.dist(v, w), j) for j, w in good if j != i)[:k]
            out |= {(i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(near)}
    return out


def test_neighbours_exact_when_every_leaf_is_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, [1.0] + [0.0] * 5) for i in range(150)] + [(2000 + i, [float(i % 3), 1.0]) for i in range(30)]
    rows += [(5000, None), (5010, []), (5020, [0.0] * 6), (5030, [None] + [1.0] * 5), (5040, [float("nan")] * 6), (5050, [float("inf")] * 6), (None, [1.0] * 6), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    settings = neighbours.Settings(recall=1.0, tests=10_000, block_rows=64, block_queries=16)
    got = neighbours.search(df, F.col("id") % 10 == 0, settings=settings).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got} == brute(rows, 10, 10)
    assert neighbours.search(df.limit(0), F.col("id") % 10 == 0).count() == 0
    few = neighbours.search(df.where("vec_id in (0, 1, 2)"), F.col("id") % 10 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = {(q, v) for q, _, v, _ in brute(rows, 10, 100)}
    got = {(r["query_id"], r["vec_id"]) for r in llm.QUERIES["op1_neighbours"](spark, sf_dir).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", None, 0), (-2, "", None, "s", 0), (None, "just a line", "en", "s", 11), (-1, None, "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs.checkpoint()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    again = corpus_pipeline.near_duplicates_stage(spark, docs.dropDuplicates(["doc_id"]), sf_dir)
    assert docs.where("n_chars <> length(text)").count() == 0
    assert again.count() >= 0.95 * sizes[-1]  # cuts and redactions can make a few more texts alike
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.count() > 0 and mixed.where("text = '' or size(doc_ids) = 0").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
