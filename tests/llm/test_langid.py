"""Codes, n-gram sums against plain Python, the whole fit against a plain one, held-out accuracy, odd rows."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carnet.llm import langid


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 20])
def test_codewords_are_apart(n):
    code = langid.codebook(n)
    assert len(code) == n and set(np.unique(code)) == {-1, 1}
    assert all((column == 1).any() and (column == -1).any() for column in code.T)
    apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
    assert apart >= (2 ** (n - 2) if n <= 6 else code.shape[1] // 5)


def plain_grams(text):
    """N-grams of two to four bytes of the prepared text, as byte strings."""
    data = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {text.lower()} ".encode())
    out = bytearray()
    for c in data:
        if not (c == 32 and out and out[-1] == 32):
            out.append(c)
    return [bytes(out[i:i + n]) for n in (2, 3, 4) for i in range(len(out) - n + 1)]


def plain_bucket(gram, buckets):
    code = (int.from_bytes(gram, "big") + len(gram)) & 0xFFFFFFFF
    code = code * 0x9E3779B1 & 0xFFFFFFFF
    code ^= code >> 15
    return ((code * 0x85EBCA77 & 0xFFFFFFFF) >> 8) % buckets


def test_sums_of_ngrams(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "A.", "Où est-ce ??", " 12 34 ", "ß" * 40, "one  two\n\nthree", "x" * 3000, "日本"] + ["".join(rng.choice("abé .,X1") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    weights = np.random.default_rng(3).integers(-3000, 3000, (257, 5)).astype(np.int32)
    column = pa.array([f" {t.lower()} ".encode() for t in texts], pa.binary())
    for piece in (langid.PIECE, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        total, count = langid.sums(column.slice(1), weights)
        for text, mine, n in zip(texts[1:], total, count):
            buckets = [plain_bucket(g, 257) for g in plain_grams(text)]
            assert n == len(buckets) and mine.tolist() == weights[buckets].sum(axis=0).tolist() if buckets else n == 0


WORDS = {"en": "the and of thing with that rather there have".split(), "fr": "le la les où être avec déjà nous quel".split(), "de": "der die das und nicht über schön auch wird".split(),
         "es": "el los que niño señor para muy está ñandú".split(), "it": "gli della perché questo anche sono più molto cosa".split()}


def corpus(rng, n, langs=tuple(WORDS)):
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 30))).capitalize() + ".", lang) for i, lang in enumerate(rng.choice(langs) for _ in range(n))]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_fit(rows, settings):
    """Languages, codewords and weights by the definition."""
    langs = sorted({r[2] for r in rows})
    code = langid.codebook(len(langs), settings.seed)
    table = {lang: {} for lang in langs}
    for _, text, lang in rows:
        for gram in plain_grams(text):
            b = plain_bucket(gram, settings.buckets)
            table[lang][b] = table[lang].get(b, 0) + 1
    rate = {lang: [(table[lang].get(b, 0) + settings.smooth) / (sum(table[lang].values()) + settings.smooth * settings.buckets) for b in range(settings.buckets)] for lang in langs}
    out = np.zeros((settings.buckets, code.shape[1]), int)
    for k in range(code.shape[1]):
        up, down = ([lang for lang, bit in zip(langs, code[:, k]) if bit == side] for side in (1, -1))
        for b in set().union(*table.values()):
            out[b, k] = round(langid.UNIT * math.log((sum(rate[x][b] for x in up) / len(up)) / (sum(rate[x][b] for x in down) / len(down))))
    return langs, code, out


def test_weights_and_decoding_equal_plain_ones(spark):
    rows = corpus(random.Random(8), 60, ("en", "fr", "de"))
    settings = langid.Settings(buckets=256)
    docs = docs_of(spark, rows)
    model = langid.fit(docs.where(~(F.pmod(F.xxhash64("text", F.lit(settings.seed + 1)), F.lit(4)) == 0)), settings)  # no row is left for the curves, so all do both
    kept = {r["doc_id"] for r in docs.where(~(F.pmod(F.xxhash64("text", F.lit(settings.seed + 1)), F.lit(4)) == 0)).collect()}
    langs, code, weights = plain_fit([r for r in rows if r[0] in kept], settings)
    assert model.languages == langs and (model.code == code).all()
    assert np.abs(model.weights - weights).max() <= 1
    found = {r["doc_id"]: r["found"] for r in langid.identify(docs, model, "found").collect()}
    for i, text, _ in rows:
        grams = [plain_bucket(g, settings.buckets) for g in plain_grams(text)]
        losses = []
        for word in code:
            loss = 0.0
            for k, bit in enumerate(word):
                margin = max(-langid.MOST, min(langid.MOST, int(model.weights[grams, k].sum()) / (langid.UNIT * math.sqrt(len(grams)))))
                loss += model.trust[k] * math.log1p(math.exp(-float(bit) * model.slopes[k] * margin))
            losses.append(loss)
        best = min(range(len(langs)), key=lambda j: (round(losses[j], 9), j))
        assert found[i]["lang"] == langs[best]
        assert found[i]["score"] == pytest.approx(math.exp(-losses[best]) / sum(math.exp(-x) for x in losses), abs=1e-6)


def test_held_out_accuracy(spark):
    """Nearly every document of the held-out fold gets its language, and short ones are those flagged."""
    from carnet.llm import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op11_langid"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    rows = found.select("held_out", "lang", "lang_pred", "score", "ambiguous").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 200 < len(held) < 500
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.985 * len(held)
    assert sum(r["ambiguous"] for r in held) <= 0.05 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    rows = corpus(random.Random(2), 300)
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 -- 34", "de"), (1003, "the " * 60_000, None), (None, "der die das", None), (1004, "日本語", "en"), rows[0], rows[0], (1005, "nicht", None), (1006, "le", None)]
    docs = docs_of(spark, rows + odd).withColumn("found", F.lit(3)).withColumn("score", F.lit("x")).withColumn("bytes", F.lit(b""))
    model = langid.fit(docs)
    again = langid.fit(docs.repartition(7))
    assert (model.weights == again.weights).all() and (model.slopes == again.slopes).all()
    got = langid.identify(docs.drop("lang", "score"), model, "__f").select("doc_id", "__f.*")
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows) + len(odd)
    assert all(by[i]["lang"] == "und" and by[i]["score"] == 0 and not by[i]["ambiguous"] for i in (1000, 1001, 1002))
    assert by[1003]["lang"] == "en" and by[None]["lang"] == "de" and by[1004]["lang"] in WORDS
    assert sum(by[i]["lang"] == lang for i, _, lang in rows) >= 0.97 * len(rows)


def test_few_languages(spark):
    rows = corpus(random.Random(3), 40)
    docs = docs_of(spark, rows)
    none = langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))), "f").select("f.lang", "f.score", "f.ambiguous").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0, False)]
    one = langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit("xx"))), "f").select("f.lang", "f.score", "f.ambiguous").distinct().collect()
    assert [tuple(r) for r in one] == [("xx", 1.0, False)]
    two = docs.where("lang in ('en', 'fr')")
    assert langid.identify(two, langid.fit(two), "f").where("f.lang <> lang").count() <= 1
    empty = docs.limit(0)
    assert langid.identify(empty, langid.fit(empty), "f").count() == 0


def test_slope_is_the_best_one():
    rng = np.random.default_rng(6)
    agreed, weight = rng.normal(1.5, 2, 300), rng.random(300)
    weight /= weight.sum()
    loss = lambda b: (weight * np.log1p(np.exp(-b * agreed))).sum() + 5e-4 * b * b
    best = langid.slope(agreed, weight)
    assert all(loss(best) <= loss(b) + 1e-12 for b in np.linspace(0, 3, 400))


def test_ambiguous_texts_are_flagged(spark):
    rows = corpus(random.Random(4), 400, ("en", "fr"))
    model = langid.fit(docs_of(spark, rows))
    tests = docs_of(spark, [(1, "the and of thing with that", "en"), (2, "the le and la", None), (3, "zzz xxx", None)])
    by = {r["doc_id"]: r["f"] for r in langid.identify(tests, model, "f").collect()}
    assert not by[1]["ambiguous"] and by[3]["ambiguous"] and by[2]["score"] < by[1]["score"]
