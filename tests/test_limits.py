"""One behaviour at every size: inputs on both sides of former limits, and odd numbers."""

import html
import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from carnet import registry
from carnet.functions import text as T
from carnet.operators import labelling as L
from carnet.operators import nearest, abbrev, context, correct, features, notes, reconcile, records, stats, suggest
from carnet.sources import readers


@pytest.mark.parametrize("extra", [0, 2_500])
def test_dictionary_with_repeated_and_null_entries(spark, extra):
    """The smallest value of a key counts and NULL says nothing, below and above the size of a literal dictionary."""
    entries = [("aa", "x2"), ("aa", "x1"), ("bb", None), (None, "z")] + [(f"k{i}", f"v{i}") for i in range(extra)]
    dictionary = spark.createDataFrame(entries, "key string, value string")
    rows = spark.createDataFrame([(1, "aa bb cc")], "id long, text string")
    assert correct.correct_tokens(rows, ["id"], "text", dictionary).first()["corrected"] == "x1 bb cc "


def test_one_text_for_many_notes(spark):
    rows = spark.range(600).select(F.lit(1).alias("p"), F.col("id").alias("at"), F.concat(F.lit("n"), F.col("id")).alias("text"))
    out = notes.concat_by_id(rows, "p", "at", "text").collect()
    assert len(out) == 1 and out[0]["text"].split() == [f"n{i}" for i in range(600)]
    assert features.prepare_notes(rows, "p", "at", "text", numbers=False).count() == 1


def test_long_terms(spark):
    rows = spark.createDataFrame([(1, "un deux trois quatre cinq six")], "id long, text string")
    terms = spark.createDataFrame([("deux trois quatre cinq", "L"), ("six", "S")], "term string, label string")
    assert {r["term"] for r in context.ngram_mentions(rows, ["id"], "text", terms).collect()} == {"deux trois quatre cinq", "six"}


def test_accents_of_every_script(spark):
    row = spark.createDataFrame([("άέ йё ếƃ Ǿ ḁ ọ̈",)], "t string").select(T.unaccent(F.col("t")).alias("t")).first()
    assert row["t"].startswith("αε ие eƃ ") and "a o" in row["t"]


def test_references_as_in_the_standard_library(spark):
    texts = ["caf&eacute; &#233;&#xE9;&#XE9", "&#128512; &#x1F600;", "&amp;lt; &lt;&gt;&quot;&apos;&nbsp;", "&unknown; & &;", "&#128; &#0; &#xD800; &#99999999;", "&#39", "&Eacute;t&eacute;&#x27;", "plain", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", abbrev.unescape(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [html.unescape(t) for t in texts]


def test_many_categories(spark):
    rows = spark.range(5_200).select(F.format_string("c%05d", "id").alias("c"), F.lit(1).alias("y"))
    wide = stats.one_hot(rows, "c")
    assert len(wide.columns) == 5_201
    sparse = stats.one_hot_sparse(rows, "c").collect()
    assert {int(r["c_onehot"].indices[0]) for r in sparse} == set(range(5_200))


def test_long_cells(spark):
    name = "s" * 12_000 + ">f"
    long = records.two_level(spark.createDataFrame([(1, "v")], f"id long, `P {name}` string"), ["id"], "P ")
    assert long.first()["nature"] == "s" * 12_000


def test_data_rows_like_the_header_stay(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(f"title {i}\nnote\na,b\n1,{i}\na,b\ntitle {i}\n")
    rows = readers.read_csv_with_late_header(spark, str(tmp_path), ["a", "b"]).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == sorted([("1", "0"), ("1", "1"), ("a", "b"), ("a", "b"), ("title 0", None), ("title 1", None)])


def test_medians_with_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(3)
    plain = [rng.choice((rng.gauss(0, 1), rng.uniform(-1e300, 1e300), 0.0, 7.0)) for _ in range(501)]
    rows = [(x, inf, -inf if i < 300 else inf, nan, None, [-1.7e308, 1.7e308, 5e-324][i % 3]) for i, x in enumerate(plain)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    got = stats.exact_medians(df, df.columns)
    assert got["a"] == statistics.median(plain) and got["b"] == inf and got["c"] == -inf and math.isnan(got["d"]) and got["e"] is None and got["f"] == 5e-324
    even = spark.createDataFrame([(1.0,), (inf,), (2.0,), (nan,)], "x double")
    assert stats.exact_median(even, "x") == inf
    filled = stats.impute(spark.createDataFrame([(1.0, "b", None), (None, None, None), (3.0, "a", None), (3.0, "a", None)], "x double, s string, n int"), ["x", "s", "n"], "most_frequent")
    assert sorted(tuple(r) for r in filled.collect()) == [(1.0, "b", None), (3.0, "a", None), (3.0, "a", None), (3.0, "a", None)]


def test_several_edits_of_one_document(spark):
    saved = spark.createDataFrame([(1, ["A.", "B."], ["A.", "B.", "C."]), (2, ["A."], ["A."])], "id long, parts array<string>, original array<string>")
    edits = spark.createDataFrame([(1, 0, "X"), (1, 2, "Y"), (1, 9, "no"), (1, 2, "W"), (2, 5, "no")], "id long, idx int, sentence string")
    assert [(r["id"], r["patched"]) for r in notes.patch_sentences(saved, edits, "id", "parts", "original").collect()] == [(1, "X. B. Y.")]
    texts = spark.createDataFrame([(1, "X. Y. Z.")], "id long, text string")
    engine = spark.createDataFrame([(1, "A. B. C.")], "id long, text string")
    resets = spark.createDataFrame([(1, 0), (1, 1), (1, 7)], "id long, idx int")
    assert [r["text"] for r in reconcile.reset_sentences(texts, engine, resets, "id").collect()] == ["A. B. Z."]


def test_long_tokens_make_no_keys(spark):
    words = spark.createDataFrame([("x" * 5_000,), ("abcde",), ("abcdf",)], "word string")
    lexicon = spark.createDataFrame([("abcdx",), ("abcde",)], "lex string")
    lengths = [5]
    assert suggest._pieces(words, "word", 60, False, "edit", lengths).groupBy("word").count().where(F.length("word") > 100).count() == 0
    assert suggest.edit1_pairs(words, lexicon, "word", "lex").count() == 3
    assert suggest.fuzzy_pairs(words, lexicon, cutoff=80).count() == 4


def test_nearest_word_for_every_word(spark):
    words = spark.createDataFrame([("zzz",), ("abc",), ("x" * 3_000,)], "word string")
    lexicon = spark.createDataFrame([("abd",), ("zzy",), ("qqq",)], "lex string")
    got = {r["word"]: (r["nearest"], r["score"]) for r in nearest.nearest_words(words, lexicon).collect()}
    assert got == {"zzz": ("zzy", 66.67), "abc": ("abd", 66.67), "x" * 3_000: ("abd", 0.0)}


def test_binned_mutual_information(spark):
    rows = spark.range(400).select((F.col("id") + 0.5).alias("x"), F.lit(1.0).alias("same"), (F.col("id") >= 200).cast("int").alias("y"))
    scores = {r["feature"]: r["score"] for r in stats.select_mi(rows, ["x", "same"], "y", bins=10).collect()}
    assert abs(scores["x"] - math.log(2)) < 1e-6 and abs(scores["same"]) < 1e-9


def test_families_of_the_patient_view(spark):
    rows = spark.createDataFrame([(1, "Un mot deux mots, IRM et PMA; nan fort+++ eleve au-dela bon jour bon soir")], "id long, text string")
    dictionary = spark.createDataFrame([("mot", "MOT")], "key string, value string")
    phrases = spark.createDataFrame([("bon jour", "bonjour"), ("bon soir", "bonsoir"), ("bon midi", "x")], "key string, value string")
    sure = spark.createDataFrame([("IRM", "imagerie")], "key string, value string")
    unclear = spark.createDataFrame([("PMA", ["a", "b"])], "key string, expansions array<string>")
    listed = spark.createDataFrame([("TYPO", "Eleve", "élève"), ("MANUAL_DICT", "deux mots", "2 mots"), ("MANUAL_DICT", "et", "&"), ("ENRICH_METIER", "absent", ""), ("TYPO", "nan", "x"), ("ABBREV_CANDIDATE", "au-dela", "")],
                                   "category string, token_source string, match string")
    every = ("DICT", "PHRASE_DICT", "ABBREV_SURE", "ABBREV_AMBIGU", "INTENSITY", "NOISE", "TYPO", "ABBREV_CANDIDATE", "ENRICH_METIER", "MANUAL_DICT")
    found = correct.patient_suggestions(rows, ["id"], "text", dictionary, phrases, sure, unclear, every, listed)
    got = {(r["family"], r["token_source"], r["match"], r["patient_occ"], r["is_auto"]) for r in correct.in_reading_order(found, ["id"]).collect()}
    assert got == {("DICT", "mot", "MOT", 1, True), ("PHRASE_DICT", "bon jour", "bonjour", 1, True), ("PHRASE_DICT", "bon soir", "bonsoir", 1, True), ("PHRASE_DICT", "deux mots", "2 mots", 1, True),
                   ("DICT", "et", "&", 1, True), ("ABBREV_SURE", "IRM", "imagerie", 1, True), ("ABBREV_AMBIGU", "PMA", "", 1, False), ("INTENSITY", "fort+++", "fort (+++)", 1, True),
                   ("NOISE", "nan", "", 1, False), ("TYPO", "eleve", "élève", 1, True), ("ABBREV_CANDIDATE", "au-dela", "", 1, False)}
    with pytest.raises(ValueError):
        correct.patient_suggestions(rows, ["id"], "text", dictionary, phrases, sure, unclear, ("TYPOS",))
    assert correct.patient_suggestions(rows, ["id"], "text", dictionary, phrases, sure, unclear, ()).count() == 0


def test_accents_of_several_words_claim_a_token(spark):
    tokens = spark.createDataFrame([("douleur aigue", 3, "invalid", 0.0, 1), ("aiguë", 2, "valid", 3.0, 1), ("mot", 1, "invalid", 0.0, 1)], "token string, n long, status string, zipf double, word_like int")
    none = spark.createDataFrame([], "key string, value string")
    unclear = spark.createDataFrame([], "key string, expansions array<string>")
    got = {r["token_source"]: (r["category"], r["match"]) for r in suggest.suggest_all(tokens, none, none, unclear).collect()}
    assert got["douleur aigue"] == ("DIACRITICS_MULTI", "douleur aiguë")


def test_topics_by_abbreviation(spark):
    rows = spark.createDataFrame([(1, "une IRM hier"), (2, "irmx"), (3, None)], "id long, text string")
    flags = {(r["id"], r["topic"]): r["hit"] for r in context.topic_flags(rows, ["id"], "text", {"IRM": (), "douleur": ("douleur",)}, exact={"IRM": ("IRM",)}).collect()}
    assert flags[1, "IRM"] and not flags[2, "IRM"] and not flags[1, "douleur"] and len(flags) == 6


def test_default_abbreviations_give_way(spark):
    sure = spark.createDataFrame([("IRM", "own"), ("TV", "own too")], "key string, value string")
    unclear = spark.createDataFrame([("RAS", ["a", "b"])], "key string, expansions array<string>")
    s, u = abbrev.with_defaults(sure, unclear)
    s, u = {r["key"]: r["value"] for r in s.collect()}, {r["key"]: list(r["expansions"]) for r in u.collect()}
    assert s["IRM"] == "own" and "RAS" not in s and s["HPV"] == "papillomavirus humain"
    assert "TV" not in u and u["RAS"] == ["a", "b"] and u["AW"] == ["arrêt de travail"]


def test_declared_partners():
    assert stats.at_most_one_of_pair(["g", "p", "age", "irm.oma", "echo.oma"]) == ["g", "age", "irm.oma"]


def test_many_copies_of_one_giver(spark):
    rows = [(1, 0, 1)] + [(2 + i % 3, i, 0) for i in range(2_500)]
    notes_ = spark.createDataFrame(rows, "p long, at long, y int")
    out = features.upsample_patients(notes_, "p", "at", "y", F.floor(F.col("at") / 256))
    copies = [r["copy"] for r in out.where("y = 1").collect()]
    assert len(copies) == 2_500 and len(set(copies)) == 2_500


def test_a_model_call_sees_few_long_texts(spark):
    """The texts of one call are bounded by their bytes, not by the rows of an Arrow batch; none is lost, null ones included."""
    def size(texts):
        return texts.map(lambda t: "" if t is None else str(len(t))).mask(texts.isna(), "none") + "/" + str(int(texts.str.len().sum()))

    texts = spark.range(400).select("id", F.when(F.col("id") % 10 != 3, F.expr("repeat('abcdefgh', 5000)")).alias("text"))
    texts = texts.unionByName(spark.range(400, 402).select("id", F.expr("repeat('x', 3000000)").alias("text"))).coalesce(1)
    got = {r["id"]: r["raw"].split("/") for r in L.infer(texts, ["id"], "text", size).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: "3000000" if i >= 400 else "none" if i % 10 == 3 else "40000" for i in range(402)}
    assert all(int(total) <= max(L.CALL_BYTES, 0 if n == "none" else int(n)) for n, total in got.values())


def test_parts_of_a_spread_table_grow_in_number(spark, tmp_path):
    """A table of few splits is dealt into more parts as it grows, not into larger ones."""
    path = str(tmp_path / "t.parquet")
    spark.range(3_000_000).select("id", F.rand(7).alias("x")).coalesce(1).write.parquet(path)
    rows = registry.spread(spark.read.parquet(path), "id")
    assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert rows.count() == 3_000_000


def seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


@pytest.mark.parametrize("by_hits", [False, True])
def test_long_notes_full_of_dictionary_words(spark, monkeypatch, by_hits):
    """A token costs the same however many entries its note holds, with a dictionary that is broadcast and with one that is joined."""
    dictionary = spark.range(48_000).select(F.format_string("k%d", "id").alias("key"), F.format_string("v%d", "id").alias("value"))
    if by_hits:
        monkeypatch.setattr(correct, "small_entries", lambda stored: None)
        monkeypatch.setattr(correct, "may_broadcast", lambda stored: False)
    notes = lambda n: spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(n))), (2, None), (3, ""), (4, "k1,x-k2 ")], "id long, text string")
    short, long = (correct.correct_tokens(notes(n), ["id"], "text", dictionary) for n in (6_000, 48_000))
    got = {r["id"]: r["corrected"] for r in short.collect()}
    assert got == {1: " ".join(f"v{i}" for i in range(6_000)) + " ", 2: None, 3: " ", 4: "v1 x v2  "}
    assert seconds(long) < 16 * seconds(short)


def test_reset_in_long_notes(spark):
    """A text is cut into sentences once, not once per sentence."""
    texts = lambda n, word: spark.createDataFrame([(1, " ".join(f"{word} {i}." for i in range(n)))], "id long, text string")
    asked = lambda n: spark.range(0, n, 2).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("idx"))
    short, long = (reconcile.reset_sentences(texts(n, "Mine"), texts(n, "Theirs"), asked(n), "id") for n in (1_000, 8_000))
    assert short.first()["text"].startswith("Theirs 0. Mine 1. Theirs 2. Mine 3. ")
    assert seconds(long) < 16 * seconds(short)


def test_words_of_many_entries_take_no_pass_each(spark, monkeypatch):
    """Entries beyond one automaton: words are joined, the automaton sees the others only, and the counts are the same."""
    texts = ["K1 k1, k2' k3 k-4 IRM irm k1 k2 kx5’ k5_a", "IRM' k9 l'os k-4 k-4", None, "", "k1’k1 été Été"]
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "k1")], "id long, text string")
    entries = [(f"k{i}", "v", False, True) for i in range(9)] + [("k-4", "w", False, True), ("IRM", "x", True, False), ("irm", "y", False, False), (" k3 ", "z", False, True),
                                                               ("l'os", "o", False, True), ("été", "e", False, True), ("k1", "other", False, False), (None, "n", False, False)]
    held = spark.createDataFrame(entries, "key string, value string, cased boolean, guard boolean").localCheckpoint()
    seen, plain = [], correct.A.count
    monkeypatch.setattr(correct.A, "count", lambda notes, text, patterns, *more: seen.extend(r["key"] for r in patterns.collect()) or plain(notes, text, patterns, *more))
    whole = sorted(map(tuple, correct.occurrences(notes, ["id"], "text", held).collect()))
    seen.clear()
    assert sorted(map(tuple, correct.occurrences(notes, ["id"], "text", held, rows=4).collect())) == whole
    assert len(whole) > 12 and sorted(seen) == ["k-4", "l'os"]
