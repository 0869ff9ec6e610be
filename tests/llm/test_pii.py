"""Base spans against plain regular expressions, added spans of planted formats, and redaction."""

import re

from pyspark.sql import functions as F

from carnet.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_base(text):
    out = []
    for nth, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and plain_luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), nth, m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "a@b.c_d@e.f.g x@y", "a@b@c.d.e", ".%+-@a-.b", "é@x.y ñ1.2.3.4.5.6.7.8.9", "256.1.1.1 1.2.3.4 001.02.3.0004 1.2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111 1111  1111 1111",
    "+1 (509) 555-6973 190.137.223.204", "+1 (509) 555-6973.", "++1+2 345 678 9012 3", "+1" + "(" * 3000, "\U0001F600 a@b.cd \U0001F600 +12 345 678 90", "a" * 30_000, "1" * 30_000, "1-" * 15_000 + "1", "a.b" * 9000 + "@x.y",
    "x@" + "a." * 9000 + "b", "1.2.3.4" * 3000, "@" * 5000, "9" * 14, "79927398713 00000000000000", "mail:a@b.co,1.1.1.1;+4912345678901",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(9, TEXTS[9]), (None, "a@b.cd")], "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1))
    rows = pii.find(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a@b.cd" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert [tuple(s) for s in r["base"]] == plain_base(text), (text or "")[:80]
        assert [tuple(s) for s in r["spans"]] == plain_base(text)  # too few to fit: nothing is added


def test_added_spans_and_redaction(spark):
    """Phones without a plus sign, in the format of those with one, are added; other numbers are not; base spans stay."""
    rows = [(i, f"call me: +1 (555) 010-{1000 + i} order {20000000 + 37 * i} on 2024/01/{10 + i % 20}") for i in range(400)]
    rows += [(1000 + i, f"phone 1 (555) 010-{3000 + i} now, a{i}@b.org") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, text in rows[:400]:
        assert [tuple(s) for s in out[i]["spans"]] == plain_base(text)
    for i, text in rows[400:]:
        phone = [s for s in out[i]["spans"] if s["kind"] == "phone"]
        assert [text[s["start"]:s["end"]] for s in phone] == [re.search(r"1 \(555\) 010-\d+", text).group()]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "call me: <PHONE> order 20000000 on 2024/01/10" and clean[1002] == "phone <PHONE> now, <EMAIL>"


def test_redaction_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "\U0001F600 a@b.cd \U0001F600"), (5, "+12345678901, 4111 1111 1111 1111")], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[1] is None and clean[2] == "" and clean[3] == "plain" and clean[4] == "\U0001F600 <EMAIL> \U0001F600"
    assert clean[5] == "<PHONE>, <CARD>"
    assert pii.redact(docs.limit(0)).count() == 0


def test_numbers_side_by_side_are_proposed(spark):
    """Every sequence of whole groups with fitting digits is a candidate, with its place; so are runs of more groups."""
    texts = ["4465758382889437 4465758382889437", "555 123 4567 555 987 6543", "4465758382889437 12/27", "call (555) 010-1234 (555) 010-9999 now", "no 1-2-3-4-5-6-7-8-9-0 x", "1.2.3.4 5.6.7.8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.prepare(docs, "text", "p").select("doc_id", "p.proposed").collect()}
    for i, text in enumerate(texts):
        got = {(c["start"], c["end"]) for c in rows[i]["proposed"] if c["kind"] != "ip"}
        want = set()
        for run in re.finditer(r"(?<![0-9A-Za-z])[(]?[0-9][0-9\x20().\-/]{5,}[0-9](?![0-9A-Za-z])", text):
            groups = [(m.start() + run.start() - (text[m.start() + run.start() - 1:m.start() + run.start()] == "(" and m.start() > 0), m.end() + run.start()) for m in re.finditer("[0-9]+", run.group())]
            for a in range(len(groups)):
                for b in range(a, len(groups)):
                    n = len(re.sub("[^0-9]", "", text[groups[a][0]:groups[b][1]]))
                    if 7 <= n <= 19 and (b - a < 6 or (a, b) == (0, len(groups) - 1)):
                        want.add((groups[a][0], groups[b][1]))
        assert got == want, text
    assert {(0, 16), (17, 33)} <= {(c["start"], c["end"]) for c in rows[0]["proposed"] if c["kind"] == "card" and c["base"]}
    assert {(0, 7), (8, 15)} <= {(c["start"], c["end"]) for c in rows[5]["proposed"] if c["kind"] == "ip" and c["base"]}


def test_adjacent_numbers_are_added_and_redacted(spark):
    """Numbers in the formats of validated ones, side by side: each is one span; base spans stay."""
    def card(i):
        head = f"4{465758382889 + i:012d}41"
        return next(head + str(d) for d in range(10) if plain_luhn(head + str(d)))

    rows = [(i, f"card {card(i)} ok, call +1 555 123 {1000 + i}") for i in range(300)]
    rows += [(1000, f"{card(1)} {card(2)}"), (1002, f"{card(3)} 12/27")]
    out = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    said = lambda i: [(s["kind"], dict(rows)[i][s["start"]:s["end"]]) for s in out[i]["spans"]]
    assert said(1000) == [("card", card(1)), ("card", card(2))] and said(1002) == [("card", card(3))]
    for i, text in rows:
        assert [tuple(s) for s in out[i]["base"]] == plain_base(text)
    rows = [(i, f"call +1 555 123 {1000 + i} today") for i in range(300)] + [(1003, "1 555 123 4567 1 555 987 6543")]
    out = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert said(1003) == [("phone", "1 555 123 4567"), ("phone", "1 555 987 6543")]


def test_many_spans_take_linear_time(spark):
    """50,000 addresses in one text."""
    import time

    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.concat(F.lit("é mail a"), i, F.lit("@b.org"))), ", ").alias("text"))
    start = time.perf_counter()
    text = pii.redact(docs).first()["text"]
    assert text == ", ".join(["é mail <EMAIL>"] * 50_000)
    assert time.perf_counter() - start < 40


def test_running_totals(spark):
    for n in (0, 1, 2, 255, 256, 257, 1000, 40_000):
        df = spark.range(1).select((F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("v"))
        out = df.select(pii.sums(F.col("v")).alias("s"), pii.running(F.transform("v", lambda x: (x * 7919) % 1009), F.greatest, F.lit(0)).alias("m")).first()
        total, most, sums, tops = 0, 0, [], []
        for x in range(1, n + 1):
            total, most = total + x, max(most, x * 7919 % 1009)
            sums.append(total), tops.append(most)
        assert list(out["s"]) == sums and list(out["m"]) == tops
