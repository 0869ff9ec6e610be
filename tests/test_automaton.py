"""The automaton against one regular expression per pattern, on random notes; dictionaries in slices; spans of every family; long notes."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from carnet.operators import automaton as A
from carnet.operators import correct as C

PIECES = ["a", "b", "c", "ab", "bc", "l'", "x+", "++", "-", "a-b", "d", "é", "A", "B", ".", "'", " ", "  ", "\n", "(", ")", "αβ", "’", "_", "3"]


def expression(p):
    """The pattern as a regular expression."""
    edge = r"\b" if p.bounded else ""
    core = rf"{A.SPACE}+".join(map(re.escape, p.source.split()))
    return re.compile(edge + core + edge + ("(?!['’])" if p.guard else ""), 0 if p.cased else re.IGNORECASE)


def random_text(rng, most=14):
    return "".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, most)))


def random_source(rng):
    return " ".join("".join(rng.choice(PIECES[:13]) for _ in range(rng.randint(1, 2))).strip() for _ in range(rng.randint(1, 3))).strip()


def random_patterns(rng):
    sources = [s for s in (random_source(rng) for _ in range(rng.randint(1, 6))) if s]
    return [A.Pattern(s, rng.random() < 0.3, rng.random() < 0.7) for s in sources]


def test_spans_are_those_of_the_expressions():
    rng = random.Random(1)
    for _ in range(8000):
        text, patterns = random_text(rng), random_patterns(rng)
        got = {i: [] for i in range(len(patterns))}
        for start, end, i in A.spans(A.Automaton(patterns), text):
            got[i].append((start, end))
        for i, p in enumerate(patterns):
            assert got[i] == [m.span() for m in expression(p).finditer(text)], (text, p.source)


def test_replacing_in_turn():
    """Values that hold later patterns, or join with what stands beside them, are treated as by one expression after the other."""
    rng = random.Random(2)
    for _ in range(8000):
        text, patterns = random_text(rng), random_patterns(rng)
        values = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 3))) for _ in patterns]
        want = text
        for p, value in zip(patterns, values):
            want = expression(p).sub(lambda _, v=value: v, want)
        assert A.replaced(text, A.Automaton(patterns), values) == want, (text, [p.source for p in patterns], values)


def plain_settled(found, order):
    kept = []
    for start, end, i in sorted(found, key=lambda s: (order[s[2]], s[0])):
        if all(end <= a or b <= start for a, b, _ in kept):
            kept.append((start, end, i))
    return sorted(kept)


def test_longest_source_wins_overlaps():
    rng = random.Random(3)
    for _ in range(3000):
        patterns = random_patterns(rng)
        order = [(*o, i) for i, o in enumerate(A.longest_first(patterns))]
        found = A.spans(A.Automaton(patterns), random_text(rng, 25))
        assert A.settled(found, order) == plain_settled(found, order)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts = [random_text(rng, 30) for _ in range(200)] + [None, ""]
    keys = sorted({s for s in (random_source(rng) for _ in range(60)) if s})
    notes = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("key", F.lit(1)).withColumn("__spans", F.lit("x"))
    return texts, keys, notes


@pytest.mark.parametrize("rows", [1000, 7])
def test_slices_give_the_same(spark, corpus, rows):
    """One automaton, and a dictionary cut into slices, find the same."""
    texts, keys, notes = corpus
    patterns = spark.createDataFrame([(k, i % 3 == 0, i % 2 == 0) for i, k in enumerate(keys)] + [(None, False, False), (" ", False, False)], A.PATTERN)
    want = {(n, p.source, p.cased, p.guard, *m.span(), m.group()) for i, k in enumerate(keys) for p in [A.Pattern(k, i % 3 == 0, i % 2 == 0)]
            for n, t in enumerate(texts) if t for m in expression(p).finditer(t)}
    found = A.find(notes.drop("__spans", "key"), "text", patterns, "s", rows=rows).select("id", F.explode("s").alias("s")).select("id", "s.*")
    assert {tuple(r) for r in found.collect()} == want
    counted = A.count(notes.drop("__spans", "key"), "text", patterns, "s", rows=rows).select("id", F.explode("s").alias("s")).groupBy("id").agg(F.sum("s.occ").alias("n"))
    totals = {}
    for n, *_ in want:
        totals[n] = totals.get(n, 0) + 1
    assert {r["id"]: r["n"] for r in counted.collect()} == totals
    assert A.find(notes.drop("__spans", "key"), "text", patterns.limit(0), "s").where("size(s) > 0").count() == 0


def test_corrections_equal_expressions_in_turn(spark, corpus):
    texts, keys, notes = corpus
    rng = random.Random(5)
    chosen = {i: rng.sample(keys, rng.randint(0, 6)) for i in range(len(texts))}
    rows = [(i, k, "<" + k.upper() + ">" if rng.random() < 0.5 else rng.choice(keys)) for i, ks in chosen.items() for k in ks]
    got = {r["id"]: r["corrected"] for r in C.apply_corrections(notes, ["id"], "text", spark.createDataFrame(rows + [(0, "", "x"), (0, "a", "")], "id int, key string, value string")).collect()}
    for i, text in enumerate(texts):
        want = text
        for _, k, v in sorted({(-len(k), k, v) for n, k, v in rows if n == i}) if text else ():
            want = expression(A.Pattern(k)).sub(lambda _, v=v: v, want)
        if want is not None and not re.search(r"\d\s*/?\s*j", want):  # time units are normalised afterwards
            assert got[i] == want


def test_spans_of_families_before_and_after(spark):
    text = "TV fait, tv normal. Toucher vaginal puis toucher  vaginal, kiste et Kiste' 5-FU"
    rows = [(1, "ABBREV_SURE", "TV", "télévision", True), (1, "PHRASE_DICT", "toucher vaginal", "TV", True), (1, "DICT", "vaginal", "x", True), (1, "TYPO", "kiste", "kyste", False),
            (1, "DICT", "kiste", "kyste", True), (1, "ABBREV_CANDIDATE", "5-fu", "", False), (2, "DICT", "fait", "dit", True)]
    notes = spark.createDataFrame([(1, text), (2, None), (3, "fait")], "id int, text string")
    selected = spark.createDataFrame(rows, "id int, family string, token_source string, match string, is_auto boolean")
    before = sorted((r["start"], r["end"], r["matched"], r["family"], r["is_auto"]) for r in C.family_spans(notes, ["id"], "text", selected).collect())
    assert [b[2:] for b in before] == [("TV", "ABBREV_SURE", True), ("Toucher vaginal", "PHRASE_DICT", True), ("toucher  vaginal", "PHRASE_DICT", True), ("kiste", "DICT", True), ("kiste", "TYPO", False), ("5-FU", "ABBREV_CANDIDATE", False)]
    assert all(text[s:e] == m for s, e, m, *_ in before)
    corrected = C.apply_corrections(notes, ["id"], "text", selected.where("id = 1 AND family IN ('TYPO', 'PHRASE_DICT')").select("id", F.col("token_source").alias("key"), F.col("match").alias("value")))
    after = C.applied_spans(corrected, ["id"], "corrected", selected.where("family IN ('TYPO', 'PHRASE_DICT')")).collect()
    # 'tv' and 'TV' as written in the note look like replacements too.
    assert sorted((r["matched"], r["family"], r["match"]) for r in after) == [("TV", "PHRASE_DICT", "TV"), ("TV", "PHRASE_DICT", "TV"), ("TV", "PHRASE_DICT", "TV"), ("kyste", "TYPO", "kyste"), ("tv", "PHRASE_DICT", "TV")]


def test_a_long_note(spark):
    """200,000 words in one note, a third of them in the dictionary."""
    notes = spark.range(1).select(F.col("id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("mot"), i % 3000))).alias("text"))
    words = spark.createDataFrame([(f"mot{i}", "x") for i in range(0, 3000, 3)] + [("mot5 mot6", "y")], "key string, value string")
    assert C.match_spans(notes, ["id"], "text", words).count() == 66_666 + 67
    pairs = words.select(F.lit(0).cast("long").alias("id"), "key", "value")
    assert C.apply_corrections(notes, ["id"], "text", pairs).first()["corrected"].startswith("mot1 mot2 x mot4 y mot7")


def test_time_is_linear_in_the_note():
    """Eight times the words take less than thirty times as long, for finding and for replacing."""
    keys = [f"mot{i}" for i in range(0, 3000, 3)] + ["mot5 mot6"]
    held, machine = A.Dictionary([(k, False, True) for k in keys]), A.Automaton([A.Pattern(k) for k in keys])

    def spent(work, words):
        text = " ".join(f"mot{i % 3000}" for i in range(words))
        start = time.process_time()
        work(text)
        return time.process_time() - start

    for work in (held.spans, lambda t: A.replaced(t, machine, ["x"] * len(keys))):
        spent(work, 5_000)
        assert spent(work, 200_000) < 30 * max(spent(work, 25_000), 0.01)


def test_many_sources_of_one_special_character():
    """Sources that differ only by the words around a comma are looked up, not tried one by one."""
    machine = A.Automaton([A.Pattern(f"mot{i},") for i in range(60_000)])
    text = ", ".join(f"mot{i}" for i in range(40_000)) + ","
    start = time.process_time()
    found = A.spans(machine, text)
    assert time.process_time() - start < 5
    # A source may begin inside a word: none of these does.
    assert len(found) == 40_000


def test_only_surroundings_of_occurrences_are_taken_apart(monkeypatch):
    """A long text costs tokens where it is changed; a replacement that leads to others far along the text still finds them."""
    made, plain = [], A._Tokens.insert
    monkeypatch.setattr(A._Tokens, "insert", lambda self, *args: made.append(1) or plain(self, *args))
    text = " ".join(["plain"] * 5000 + ["Σ old", "x"] + ["plain"] * 5000)
    assert A.replaced(text, A.Automaton([A.Pattern("old")]), ["new"]) == text.replace("old", "new")
    assert len(made) < 100
    # Each value makes the next pattern with the words that follow it.
    patterns = [A.Pattern(f"s{i} w{i}") for i in range(60)]
    text = "s0 " + " ".join(f"w{i}" for i in range(60)) + " end"
    assert A.replaced(text, A.Automaton(patterns), [f"s{i + 1}" for i in range(60)]) == "s60 end"
