"""Behaviour scenarios on literal frames: corrections, missing data, normalisation, statistics, source priority."""

from pyspark.sql import functions as F

from carnet.functions import text as T
from carnet.operators import correct as C
from carnet.operators import profile as M
from carnet.operators import reconcile as J
from carnet.operators import records as P
from carnet.operators import stats as Z
from carnet.operators import suggest as G
from carnet.operators import vocab as V


def pairs(spark, entries):
    return spark.createDataFrame(list(entries.items()), "key string, value string")


def test_dictionary_leaves_no_known_fault(spark):
    faults = {"irmm": "IRM", "pelvine": "pelvienne", "endometriose": "endométriose", "doulleurs": "douleurs", "kiste": "kyste", "ovarre": "ovaire"}
    note = spark.createDataFrame([(1, "doulleurs,kiste/ovarre endometriose-pelvine irmm.")], "id int, text string")
    out = C.correct_tokens(note, ["id"], "text", pairs(spark, faults)).first()["corrected"]
    assert out == "douleurs kyste ovaire endométriose pelvienne IRM  "
    assert not any(f in out.split() for f in faults)


def test_large_and_small_dictionary_paths_agree(spark, monkeypatch):
    notes = spark.createDataFrame([(i, f"k{i} x k{i + 1},it's k{i}") for i in range(50)], "id int, text string")
    entries = pairs(spark, {f"k{i}": f"v{i}" for i in range(40)} | {"it's": "it \\ is"})
    small = sorted(C.correct_tokens(notes, ["id"], "text", entries).collect())
    monkeypatch.setattr("carnet.operators.correct.small_entries", lambda stored: None)
    assert sorted(C.correct_tokens(notes, ["id"], "text", entries).collect()) == small
    assert small[0]["corrected"] == "v0 x v1 it \\ is v0 "


def test_unknown_words_are_flagged(spark):
    vocab = spark.createDataFrame([("douleur", 5), ("dolleur", 1), ("ulcere", 2), ("ulcère", 3), ("de", 9), ("12cm", 1)], "token string, n long")
    reference = spark.createDataFrame([("douleur", 10), ("ulcère", 5), ("de", 100)], "token string, n long")
    lexicon = spark.createDataFrame([("douleur",), ("ulcère",)], "word string")
    status = {r["token"]: r["status"] for r in V.with_validity(V.with_zipf(vocab, reference), lexicon).collect()}
    assert status == {"douleur": "valid", "dolleur": "invalid", "ulcere": "to_fix", "ulcère": "valid", "de": "valid", "12cm": "invalid"}


def test_only_nearly_complete_patients_remain(spark):
    rows = [("p1", 1.0, None, 3.0), ("p2", None, None, 1.0), ("p3", 2.0, 1.0, None), ("p4", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double")
    shares = {r["id"]: r["percent_missing"] for r in M.missing_by_row(df, "id", ["a", "b", "c"]).collect()}
    assert round(shares["p1"], 2) == 33.33 and round(shares["p2"], 2) == 66.67 and shares["p4"] == 0
    assert [r["id"] for r in M.keep_complete_rows(df, ["a", "b", "c"], 20).collect()] == ["p4"]


def test_columns_without_data_are_dropped(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "id int, empty string, half string")
    assert P.drop_columns_and_empty(df, []).columns == ["id", "half"]
    assert M.keep_complete_columns(df, ["empty", "half"], 100).columns == ["id", "half"]
    assert M.keep_complete_columns(df, ["empty", "half"], 50).columns == ["id"]


def test_yes_no_spellings_become_booleans(spark):
    df = spark.createDataFrame([("Oui",), ("NON",), ("true",), ("False",), ("peut-être",), (None,)], "v string")
    assert [r[0] for r in df.select(P.as_bool(F.col("v"))).collect()] == [True, False, True, False, None, None]


def test_retype_truth_table(spark):
    cells = ["42", "2024-01-02 03:04:05", "01/02/2024 03:04:05", "oui", "Non", "NaN", "texte", "2024-01-02", "99999999999999999999"]
    df = spark.createDataFrame([(c,) for c in cells], "v string").select("v", P.retype(F.col("v")).alias("t")).select("v", "t.*")
    got = {r["v"]: (r["v_long"], str(r["v_ts"]) if r["v_ts"] else None, r["v_bool"], r["v_str"]) for r in df.collect()}
    assert got["42"] == (42, None, None, None)
    assert got["2024-01-02 03:04:05"] == (None, "2024-01-02 03:04:05", None, None)
    assert got["01/02/2024 03:04:05"] == (None, "2024-01-02 03:04:05", None, None)
    assert got["oui"] == (None, None, True, None) and got["Non"] == (None, None, False, None)
    assert got["NaN"] == (None, None, None, None) and got["texte"] == (None, None, None, "texte")
    assert got["99999999999999999999"] == (None, None, None, "99999999999999999999")


def test_significant_variables(spark):
    rows = [(int(i % 2 == 0), "a" if i % 2 == 0 else "b", "x" if i % 3 else "y") for i in range(60)]
    df = spark.createDataFrame(rows, "outcome int, strong string, weak string")
    verdicts = {r["feature"]: r["verdict"] for r in Z.chi2_tests(df, ["strong", "weak"], "outcome").collect()}
    assert verdicts == {"strong": "significant", "weak": "none"}


def test_p_values_match_tables():
    assert abs(Z._gamma_q(0.5, 3.841459 / 2) - 0.05) < 1e-6
    assert abs(Z._gamma_q(5, 18.307038 / 2) - 0.05) < 1e-6
    assert abs(Z._beta_i(5, 0.5, 10 / (10 + 2.228139 ** 2)) - 0.05) < 1e-6


def test_source_match_and_priority(spark):
    sheet = spark.createDataFrame([(1, "1", None), (2, "0", "b")], "id int, x string, y string")
    notes = spark.createDataFrame([(1, "1", "a"), (2, "1", "b"), (3, "0", None)], "id int, x string, y string")
    rates = {r["variable"]: r["match_rate"] for r in J.match_rate(sheet, notes, "id", ["x", "y"]).collect()}
    assert rates == {"x": 0.5, "y": 0.5}
    by_notes = {r["id"]: (r["x"], r["y"]) for r in J.merge_by_priority(notes, sheet, "id", ["x", "y"], "notes").collect()}
    by_sheet = {r["id"]: (r["x"], r["y"]) for r in J.merge_by_priority(notes, sheet, "id", ["x", "y"], "sheet").collect()}
    assert by_notes == {1: ("1", "a"), 2: ("1", "b"), 3: ("0", None)}
    assert by_sheet == {1: ("1", "a"), 2: ("0", "b"), 3: ("0", None)}


def test_each_token_has_one_family(spark):
    tokens = spark.createDataFrame(
        [("douleurr", 2, 0.0, 1, "invalid"), ("douleur", 9, 5.0, 1, "valid"), ("ecole", 1, 0.0, 1, "to_fix"), ("école", 1, 4.0, 1, "valid"), ("TV", 3, 0.0, 1, "invalid"),
         ("IRM", 3, 0.0, 1, "invalid"), ("XYZ", 1, 0.0, 1, "invalid"), ("fort+++", 1, 0.0, 0, "invalid"), ("faut", 1, 0.0, 1, "invalid"), ("12", 1, 0.0, 0, "invalid")],
        "token string, n long, zipf double, word_like int, status string")
    dictionary = pairs(spark, {"faut": "faute"})
    sure = pairs(spark, {"IRM": "imagerie par résonance magnétique"})
    ambiguous = spark.createDataFrame([("TV", ["toucher vaginal", "télévision"])], "key string, expansions array<string>")
    rows = G.suggest_all(tokens, dictionary, sure, ambiguous).collect()
    got = {r["token_source"]: (r["category"], r["match"]) for r in rows}
    assert len(rows) == len(got)
    assert got == {
        "douleurr": ("TYPO", "douleur"), "ecole": ("DIACRITICS_STRICT", "école"), "TV": ("ABBREV_AMBIGU", ""), "IRM": ("ABBREV_SURE", "imagerie par résonance magnétique"),
        "XYZ": ("ABBREV_CANDIDATE", ""), "fort+++": ("INTENSITY", "fort (+++)"), "faut": ("MANUAL_DICT", "faute"), "12": ("REJECTED", "")}
    assert {r["token_source"]: r["expansions"] for r in rows}["TV"] == "toucher vaginal | télévision"


def test_sentences_round_trip(spark):
    texts = ["Première phrase. Deuxième ? Oui !", "a|b\nc", "", "Sans point"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.join_sentences(T.sentences(F.col("t")))).collect()]
    assert got == ["Première phrase. Deuxième ? Oui !", "a. b. c.", "", "Sans point."]
    again = spark.createDataFrame([(g,) for g in got], "t string").select(T.join_sentences(T.sentences(F.col("t")))).collect()
    assert [r[0] for r in again] == got
