"""Readers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from carnet.operators import records as P
from carnet.sources import readers as R
from carnet.sources import sinks as W


def test_csv_with_late_header(spark, tmp_path):
    late = tmp_path / "late.csv"
    late.write_text("Export du jour\nversion 2\nNUM_INCLUSION,CIMCD, CIM_LIBELLE_COMPLET\n1,N80,Endométriose\n2,,Kyste\n", encoding="utf-8")
    plain = tmp_path / "plain.csv"
    plain.write_text("NUM_INCLUSION,CIMCD,CIM_LIBELLE_COMPLET\n1,N80,Endométriose\n2,,Kyste\n", encoding="utf-8")
    required = ["NUM_INCLUSION", "CIMCD", "CIM_LIBELLE_COMPLET"]
    for path in (late, plain):
        rows = R.ingest_codes(R.read_csv_with_late_header(spark, str(path), required), *required)
        assert sorted(tuple(r) for r in rows.collect()) == [("1", "N80 - Endométriose"), ("2", "Kyste")]


def test_missing_inputs_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="b"):
        R.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    with pytest.raises(FileNotFoundError):
        R.require_paths(spark, [str(tmp_path / "absent")])
    with pytest.raises(ValueError, match="diag"):
        R.ingest_sheet(spark.createDataFrame([("1",)], "id string"), "id", "diag endo profonde")


def test_dictionaries(spark, tmp_path):
    (tmp_path / "dict.json").write_text(json.dumps({" IRMm ": "IRM", "mal de  tete": "céphalée", "x": ""}), encoding="utf-8")
    rows = {r["key"]: (r["value"], r["kind"]) for r in R.read_dictionary(spark, str(tmp_path / "dict.json")).collect()}
    assert rows == {"irmm": ("IRM", "single"), "mal de  tete": ("céphalée", "phrase")}
    (tmp_path / "amb.json").write_text(json.dumps({"tv": ["toucher vaginal", " télévision "], "AW": "arrêt de travail"}), encoding="utf-8")
    rows = {r["key"]: r["expansions"] for r in R.read_list_map(spark, str(tmp_path / "amb.json")).collect()}
    assert rows == {"TV": ["toucher vaginal", "télévision"], "AW": ["arrêt de travail"]}


def test_lines(spark, tmp_path):
    (tmp_path / "texts.txt").write_text(" un \n\n  \ndeux\n", encoding="utf-8")
    assert sorted(r["text"] for r in R.read_lines(spark, str(tmp_path / "texts.txt")).collect()) == ["deux", "un"]


def test_suggestion_aliases(spark):
    df = spark.createDataFrame([(" kiste ", "kyste", "3", "typo"), ("", "x", "1", "TYPO"), ("b", "c", "d", "OTHER")], ["Source", "target", "occ", "Category"])
    rows = R.read_suggestions(df, "TYPO").collect()
    assert [(r["token_source"], r["match"], r["count"], r["score"], r["expansions"]) for r in rows] == [("kiste", "kyste", 3, None, "")]


def test_suggestions_by_family(spark, tmp_path):
    df = spark.createDataFrame([("a", "TYPO"), ("b", "DICT"), ("c", "TYPO")], "token_source string, category string")
    W.write_suggestions(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("category=*")) == ["category=DICT", "category=TYPO"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_export_documents(spark, tmp_path):
    patients = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "patient_id string")
    saved = spark.createDataFrame([("p1", "corrigé"), ("p2", "  ")], "patient_id string, text_after string")
    source = spark.createDataFrame([("p1", "brut"), ("p2", "brut 2")], "patient_id string, text string")
    W.write_export(W.export_rows(patients, saved, source, "2024-01-01T00:00:00"), str(tmp_path / "export"))
    docs = {r["patient_id"]: r["text_after"] for r in spark.read.json(str(tmp_path / "export")).collect()}
    assert docs == {"p1": "corrigé", "p2": "brut 2", "p3": ""}


def test_run_metadata(spark, tmp_path):
    predictions = spark.createDataFrame([(1, "OUI"), (2, "NON")], "id int, prediction string")
    meta = json.loads(W.write_run(predictions, str(tmp_path / "run"), model="m", task="t").first()["meta"])
    assert meta["input_rows"] == 2 and meta["model"] == "m" and "timestamp" in meta
    assert spark.read.parquet(str(tmp_path / "run/predictions")).count() == 2


def test_swallowed_records_are_restored(spark):
    bad = "fin_x000D_\n3;c3;d3;trop\n4;c4\n"
    df = spark.createDataFrame([("1", "a", "b"), ("2", "x", bad.replace("\n4", ";;\n4"))], "id string, c string, d string")
    got = sorted(tuple(r) for r in P.repair_malformed(df, ["id", "c", "d"]).collect())
    assert got == [("1", "a", "b"), ("2", "x", "fin"), ("3", "c3", "d3"), ("4", "c4", None)]


def test_parallel_cells_explode_by_position(spark):
    df = spark.createDataFrame([(1, "a | b | c", "x | y"), (2, "q", None)], "id int, u string, v string")
    got = sorted((r["id"], r["pos"], r["u"], r["v"]) for r in P.explode_multi(df, ["id"], ["u", "v"]).collect())
    assert got == [(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "c", None), (2, 0, "q", None)]
    assert [r[0] for r in df.select("id", P.multi_value_count(["u", "v"]).alias("n")).orderBy("id").select("n").collect()] == [3, 1]


def test_two_level_names(spark):
    df = spark.createDataFrame([(1, "v", "w")], ["id", "Gynécologie > Consultation>Date", "Nom"])
    got = {(r["nature"], r["acte"]): r["value"] for r in P.two_level(df, ["id"], "Gynécologie > ").collect()}
    assert got == {("Consultation", "Date"): "v", ("Nom", ""): "w"}


def test_separator_scan_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a|b", "c"), (2, None, None)], "id int, u string, v string")
    assert {r["column_name"]: r["has_separator"] for r in P.separator_columns(df).collect()} == {"u": True, "v": False}
    assert df.select(F.size(P.cell_values(F.col("u"), "|"))).first()[0] == 2
