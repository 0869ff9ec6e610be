"""Truth tables for text rules that SQL cannot express exactly."""

import re

from pyspark.sql import functions as F

from carnet.functions import text as T
from carnet.operators import abbrev as A
from carnet.operators import correct as C
from carnet.operators import labelling as L
from carnet.operators import notes as N
from carnet.operators import reconcile as J


def values(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


def test_unaccent_modes(spark):
    assert values(spark, T.unaccent, "Éçàœñ", "é") == ["Ecaœn", "e"]
    assert values(spark, lambda c: T.unaccent(c, "ascii"), "cœur Æ ß") == ["coeur AE ss"]


def test_time_units(spark):
    assert values(spark, T.time_units, "3/j", "10 / J pendant 7j", "qq j", "été3j") == ["3 / jour", "10 / jour pendant 7 jours", "quelques jours", "été3j"]


def test_intensity_forms(spark):
    assert values(spark, T.intensity_text, "douleur+++ vive", "A++ reste", "fièvre++") == ["douleur (+++) vive", "A++ reste", "fièvre (++)"]
    assert values(spark, T.intensity_token, "souple++++", "souple+", "été++") == ["souple (++++)", None, "été (++)"]


def test_question_mark_repair(spark):
    damaged = ["c?lioscopie", "s?ur", "l?estomac", "man?uvre", "qu?elle", "ac?on", "na?onale", "?stradiol", "douleur?", "(test)", "???", "lac?lioscopie", "C?était"]
    wanted = ["coelioscopie", "soeur", "l'estomac", "manoeuvre", "qu'elle", "action", "nationale", "estradiol", "douleur", "test", "", "la coelioscopie", "c'était"]
    assert values(spark, N.question_repair, *damaged) == wanted


def test_mail_scrub(spark):
    got = values(spark, T.scrub_mails, "écrire à jean.dupont7@mail.fr ou jean dupont", "pas de mail")
    assert got == ["écrire à  ou  ", "pas de mail"]


def test_phrase_occurrences_and_guard(spark):
    notes = spark.createDataFrame([(1, "Toucher  vaginal normal, toucher vaginal' non, touchervaginal")], "id int, text string")
    phrases = spark.createDataFrame([("toucher vaginal", "TV")], "key string, value string")
    assert [(r["key"], r["occ"]) for r in C.phrase_occurrences(notes, ["id"], "text", phrases).collect()] == [("toucher vaginal", 1)]


def test_entries_with_other_characters_are_counted(spark):
    notes = spark.createDataFrame([(1, "5-FU puis 5-fu, contre-indication et s. f. vu")], "id int, text string")
    entries = spark.createDataFrame([("5-FU", "fluoro"), ("puis", "ensuite")], "key string, value string")
    cased = C.occurrences(notes, ["id"], "text", C.with_patterns(entries, ignore_case=False))
    assert {(r["key"], r["occ"]) for r in cased.collect()} == {("5-FU", 1), ("puis", 1)}
    entries = spark.createDataFrame([("contre-indication", "CI"), ("5-fu", "fluoro")], "key string, value string")
    lower = C.occurrences(notes, ["id"], "text", C.with_patterns(entries))
    assert {(r["key"], r["occ"]) for r in lower.collect()} == {("contre-indication", 1), ("5-fu", 2)}


def test_separators_and_labels(spark):
    texts = ["a\n=====\nb", "a ==== b = c", "x\n\n ==== \n\ny", "===\n\n\nz\n ====="]
    whole_lines = [re.sub(r"(?m)^\s*={3,}\s*$", "", t) for t in texts]
    assert values(spark, T.strip_separators, *texts) == [re.sub(r"[ \t]{2,}", " ", re.sub(r"={3,}", " ", t)) for t in whole_lines]
    assert values(spark, T.strip_leading_label, " APRÈS \n\n\ntexte", "texte après") == ["texte", "texte après"]


def test_longest_source_is_applied_first(spark):
    notes = spark.createDataFrame([(1, "mal de tete, mal au dos l'mal' 3j"), (2, "rien 2/j")], "id int, text string")
    sugs = spark.createDataFrame([(1, "mal", "douleur"), (1, "mal de tete", "céphalée $1")], "id int, key string, value string")
    out = {r["id"]: r["corrected"] for r in C.apply_corrections(notes, ["id"], "text", sugs).collect()}
    assert out == {1: "céphalée $1, douleur au dos l'mal' 3 jours", 2: "rien 2 / jour"}


def test_annotation_is_idempotent(spark):
    choices = spark.createDataFrame([(1, "TV", "toucher vaginal")], "id int, key string, value string")
    notes = spark.createDataFrame([(1, "TV normal, TV [télévision], tv")], "id int, text string")
    once = C.annotate_abbreviations(notes, ["id"], "text", choices)
    assert once.first()["annotated"] == "TV [toucher vaginal] normal, TV [toucher vaginal], tv"
    twice = C.annotate_abbreviations(once.withColumnRenamed("annotated", "text"), ["id"], "text", choices)
    assert twice.first()["annotated"] == once.first()["annotated"]


def test_spans_point_at_the_match(spark):
    notes = spark.createDataFrame([(1, "Été: kiste, Kiste")], "id int, text string")
    words = spark.createDataFrame([("kiste", "kyste")], "key string, value string")
    got = sorted((r["start"], r["end"], r["matched"]) for r in C.match_spans(notes, ["id"], "text", words).collect())
    assert got == [(5, 10, "kiste"), (12, 17, "Kiste")]


def test_entities_and_expansions(spark):
    assert values(spark, A.unescape, "a&#91;5&#93;&amp;&lt;b&gt;&#8217;") == ["a[5]&<b>’"]
    raw = ["toucher vaginal, télévision ou Toucher Vaginal / autre [3]", "couteau", "a or b; c"]
    assert values(spark, A.split_expansions, *raw) == [["toucher vaginal", "télévision", "autre"], ["couteau"], ["a", "b", "c"]]


def test_accept_key(spark):
    keys = ["TV", "sf", "xx", "Des", "irm", "Irm", "TROPLONG", "A+", " HPV "]
    assert values(spark, A.accept_key, *keys) == ["TV", "sf", None, None, None, "IRM", None, None, "HPV"]


def test_ambiguous_forms(spark):
    amb = spark.createDataFrame([("EC", ["échographie", "examen clinique"]), ("SF", ["sage-femme"]), ("TONO", ["tonus"])], "key string, expansions array<string>")
    notes = spark.createDataFrame([(1, "Ec fait, EC refait"), (2, "Ec vu"), (3, "sf ok ec"), (4, "tono")], "id int, text string")
    none = spark.createDataFrame([], "key string, value string")
    found = C.patient_suggestions(notes, ["id"], "text", none, none, none, amb, ("ABBREV_AMBIGU",))
    got = {(r["id"], r["token_source"], r["patient_occ"]) for r in found.collect()}
    assert got == {(1, "EC", 1), (2, "Ec", 1), (3, "sf", 1)}


def test_chunks_cover_the_text(spark):
    texts = ["x" * n for n in (0, 5, 10, 11, 18, 19, 100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for i, text in enumerate(texts):
        parts = sorted((r["start"], r["part"]) for r in L.chunk(df.where(F.col("id") == i), ["id"], "t", size=10).collect())
        covered = set()
        for start, part in parts:
            assert part == text[start:start + 10]
            covered |= set(range(start, start + len(part)))
        assert covered == set(range(len(text)))
        assert all(len(p) == 10 for _, p in parts) or len(text) <= 10


def test_answers(spark):
    raw = ["LABEL: OUI\nJUSTIF: x", "non, rien", "label: ambigu", "???", "  oui"]
    assert values(spark, L.parse_answer, *raw) == ["OUI", "NON", "AMBIGU", "AMBIGU", "OUI"]


def test_vote_prefers_yes_then_no(spark):
    rows = [(1, 0, "non", "n0"), (1, 1, "oui", "y1"), (2, 0, "ambigue", "a0"), (2, 1, "non", "n1"), (3, 0, "ambigue", "a"), (3, 1, "ambigue", "b"), (3, 2, None, None)]
    df = spark.createDataFrame(rows, "id int, pos int, label string, reason string")
    got = {r["id"]: (r["classification"], r["justification"]) for r in L.vote(df, ["id"], "pos", "label", "reason").collect()}
    assert got == {1: ("oui", "y1"), 2: ("non", "n1"), 3: ("ambigue", "a b")}


def test_sentence_reset(spark):
    saved = spark.createDataFrame([(1, "A1. B."), (2, "X. Y2."), (3, "M. N.")], "id int, text string")
    engine = spark.createDataFrame([(1, "A. B."), (2, "X. Y."), (3, "M. P.")], "id int, text string")
    resets = spark.createDataFrame([(1, 0), (2, 0), (3, 7)], "id int, idx int")
    got = {r["id"]: r["text"] for r in J.reset_sentences(saved, engine, resets, "id").collect()}
    assert got == {2: "X. Y2.", 3: "M. N."}


def test_infer_retries(spark):
    class Flaky:
        calls = 0

        def __call__(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise RuntimeError("busy")
            return texts.map(lambda t: "LABEL: OUI" if "douleur" in t else "LABEL: NON")

    df = spark.createDataFrame([(1, "douleur"), (2, "rien")], "id int, text string").coalesce(1)
    got = {r["id"]: r["prediction"] for r in L.infer(df, ["id"], "text", Flaky()).collect()}
    assert got == {1: "OUI", 2: "NON"}


def test_suggestions_read_the_documents_once(spark, sf_dir, monkeypatch):
    """Acronyms come from the stored vocabulary and are those of the documents."""
    from carnet.plans import inputs, vocabulary

    read, plain = [], inputs.table
    monkeypatch.setattr(inputs, "table", lambda spark, d, name: read.append(name) or plain(spark, d, name))
    vocabulary.all_suggestions(spark, sf_dir)
    assert read.count("documents") == 1
    tokens = inputs.token_table(spark, sf_dir)
    for by_notes, by_words in zip(inputs.abbreviations(spark, sf_dir), inputs.abbreviations(spark, sf_dir, tokens)):
        assert sorted(map(str, by_notes.collect())) == sorted(map(str, by_words.collect())) != []


def test_tokens_in_one_pass_are_those_of_two(spark):
    odd = "\x1c É'a_b  Ça-va!́ 　x\t\n٣²\U0001d54f  İ\x85y.z"
    rows = spark.createDataFrame([(odd,), ("",), (None,), (" - ",)], "text string")
    c = F.col("text")
    from carnet.plans.inputs import raw_tokens
    for got, want in rows.select(T.norm_tokens(c), T.space_tokens(T.lower_punct(c))).collect() + rows.select(raw_tokens(c), T.space_tokens(T.squeeze(c))).collect():
        assert got == want
