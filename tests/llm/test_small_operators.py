"""Decontamination, token counts, chats, URL filters and mixing on small tables, against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carnet.llm import chat, decontam, mixing, tokencount, urlfilter
from carnet.llm.queries import tokenizer_path

# --- decontamination ---


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items, n=10):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == own[i:i + size]:
                    hit |= set(range(j, j + size))
                    if name is not None:
                        names.add(str(name))
    return len(words), len(hit), sorted(names)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (10, "Short item"), (2, "one two three four five six seven eight nine ten"), (3, None), (4, " ,, "), (None, "Été à la plage"), (5, "short ITEM")]
TEXTS = ["x ONE two, three four five six seven eight nine ten! eleven y", "short item short item", None, "", "nothing here", "ÉtÉ Été à la plage", "one two three four five six seven eight nine",
         "a " * 20_000 + "one two three four five six seven eight nine ten eleven twelve", "shorts items"]


@pytest.mark.parametrize("max_bytes", [1 << 20, 40])
def test_hits(spark, max_bytes):
    """One set, and a set dealt into slices, give the same hits."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0])], "doc_id long, text string").withColumn("items", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("hits", F.lit(1))
    rows = decontam.find_hits(docs, items, "found", max_bytes=max_bytes).select("doc_id", "text", "found", decontam.n_hit(F.col("found")).alias("n")).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r["found"]["n_words"], r["n"], list(r["found"]["items"])) == plain_hits(r["text"], ITEMS), r["text"]


def test_decontaminate(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("found", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, items).select("doc_id", "text").collect()}
    assert set(kept) == {2, 3, 4, 6, 7, 8}
    for i in (2, 3, 4, 6, 8):
        assert kept[i] == TEXTS[i]
    assert kept[7].startswith("a a a") and plain_hits(kept[7], ITEMS)[1] == 0
    assert decontam.decontaminate(docs, items.limit(0)).count() == len(TEXTS)
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


# --- token counts ---


def test_token_counts(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(4)
    texts = [None, "", " ", "a" * 50_000, "x <|endoftext|> y", "naïve café 1234 $5.00 don't", "日本語 текст\u2009thin", "tab\tline\r\n\n  end  ", "\x1c\x85\u00a0mix"]
    texts += ["".join(rng.choice("ab 'sStT\n\t  .,!?012éàžΩЯ—…€²日\u3000\x1f") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "again")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    for r in tokencount.count_tokens(docs, tokenizer_path(), "n").collect():
        text = r["text"] or ""
        assert r["n"]["n_bytes"] == len(text.encode()) and r["n"]["n_tokens"] == len(plain.encode(text, add_special_tokens=False)), text
    assert tokencount.count_tokens(docs.limit(0), tokenizer_path(), "n").count() == 0


# --- chats ---


def test_chat_round_trip(spark):
    hard = ["", "\\", "\\\\", "### x: y", "</turn>", "<\\/turn>", "a</turn>\n### assistant: b", "<image:0>", "</turn", "<", "####", None, "x" * 100_000, "é\n</turn></turn>"]
    turns = [(1, i, ["user", "assistant", "a: b\\", None][i % 4], t) for i, t in enumerate(hard)] + [(2, None, "assistant", "last"), (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a"), (None, 0, "user", "alone"), (3, 0, None, None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text"))).withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.format_chats(rows).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r or "", t or "") for _, _, r, t in turns[:len(hard)]]
    assert out[1]["learned"] == "".join(t or "" for _, _, r, t in turns[:len(hard)] if r == "assistant")
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "last")]
    assert out[None]["n_turns"] == 1 and out[3]["turns"] == [("", "")]
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_chat_attachments(spark):
    parts = [("text", "see <image:7>", None, None), ("image", None, "s3/a.png", 2.0), ("audio", None, "b.wav", 1.5), ("text", "and", None, None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("document", None, "c.pdf", None), ("video", None, "d", 3.0)]), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(rows).collect()[0]
    assert r["formatted"] == "### user: see <\\image:7><image:0><audio:1>and</turn>\n### assistant: <document:2><document:3></turn>\n### assistant: </turn>"
    assert [(a["kind"], a["ref"], a["turn"], a["tokens"]) for a in r["attachments"]] == [("image", "s3/a.png", 0, 425), ("audio", "b.wav", 0, 52), ("document", "c.pdf", 1, 3), ("document", "d", 1, 1503)]
    assert r["attachment_tokens"] == 425 + 52 + 3 + 1503


# --- URL filters ---


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/x/?b=2&a=1&utm_source=q#top", "http://a.example.com/x?a=1&b=2", "http://b.org?x", "http://c.org#f", "ftp://net/es/1", "http://x.net/fr", "http://x.net/fr/1", "x://" + "y" * 50_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(4, urls[4])], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    listed = spark.createDataFrame([("https://A.example.com/x/?a=1&b=2",), ("http://c.org/",), (None,), ("bad",)], "url string")
    rules = (("net", "/es/", "block"), ("net", "/", "allow"))
    rows = urlfilter.judge(pages, listed, rules).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: r for r in rows}
    assert [got[i]["verdict"] for i in range(11)] == ["allow", "allow", "allow", "block", "block", "allow", "block", "block", "allow", "allow", "allow"]
    assert (got[3]["host"], got[3]["path"]) == ("a.example.com", "/x/") and (got[0]["host"], got[0]["path"]) == ("", "")
    assert got[7]["rule"] == "net/es/" and got[8]["rule"] == "net/" and got[3]["rule"] is None
    assert urlfilter.judge(pages, listed.limit(0), ()).where("verdict = 'block'").count() == 0
    assert urlfilter.judge(pages.limit(0), listed, rules).count() == 0


def test_filter_lets_every_listed_key_pass(spark):
    """No listed key is refused, few others pass, and the join removes those."""
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = urlfilter.filter_size(10_000)
    table = urlfilter.bloom(keys.where("substring(key, 2) < 10000"), "key", blocks)
    mask = urlfilter.mask_of(F.col("key"))
    passed = keys.join(table, (urlfilter.block_of(F.col("key"), blocks) == F.col("block")) & (F.col("word").bitwiseAND(mask) == mask))
    listed = keys.where("substring(key, 2) < 10000").count()
    assert table.count() <= blocks and listed <= passed.count() <= listed + 400
    assert urlfilter.listed_in(keys, "key", keys.where("substring(key, 2) < 10000"), "key", "hit").where("hit").count() == listed


# --- mixing ---


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**{s: most * sizes[s] for s in full}, **share}
        full |= over


def test_mixing(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 12 + ["b", "é", None, "Z", "tiny"][: 5 if i % 40 == 0 else 4])
        rows.append((i, " ".join("w" for _ in range(rng.choice((0, 3, 90, 700)))), source))
    rows += [(5, "same words here", "b")] * 3 + [(None, "no id", None), (901, None, "b"), (902, "x " * 30_000, "Z"), (903, " \t\n", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("owner", F.lit(1))
    got = mixing.mix(docs, with_text=False).taken().collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    again = mixing.mix(docs.repartition(7), with_text=False).taken().collect()
    assert Counter(got) == Counter(again)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = plain_targets({s: sizes[s] for s in {s for *_, s in rows}})
    found = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        found.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert set(found) == {(sizes[s], round(t, 6)) for s, t in targets.items()}
    for (_, target), taken in found.items():
        assert abs(sum(taken) - target) <= max(64, 0.02 * target)


def test_mixed_texts(spark):
    rows = [(i, " ".join(f"{s}{i}x{j}" for j in range(50 + 37 * i)), s) for s in "ab" for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix(docs, mixing.Plan(block_words=40, min_blocks=4, shard_slots=16))
    slots = mix.texts().collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) and {r["shard"] for r in slots} == set(range(max(r["shard"] for r in slots) + 1))
    assert all(len(r["text"].split()) <= 40 for r in slots)
    words = Counter(w for r in slots for w in r["text"].split())
    taken = sum(r["taken"] for r in mixing.mix(docs, mixing.Plan(block_words=40, min_blocks=4, shard_slots=16), with_text=False).taken().collect())
    assert sum(words.values()) == taken and max(words.values()) <= 3
    known = {w for _, t, _ in rows for w in t.split()}
    assert set(words) <= known and all(w[0] == r["source"] for r in slots for w in r["text"].split())


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        found = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit("s")).alias("p")).collect()
        assert sorted(r["p"] for r in found) == list(range(n))
    assert [r["p"] for r in found] != list(range(1000))


def test_empty_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs, with_text=False).taken().count() == 0
    assert mixing.mix(docs).texts().count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank, with_text=False).taken().collect()] == [0, 0]


def test_thousands_of_turns(spark):
    """A conversation of 4,000 turns is formatted, read back and masked whole."""
    turns = spark.range(4_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é \\ text "), F.col("id")).alias("text"))
    chats = chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    row = chats.select(chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned"), F.size(chat.parse(F.col("formatted"))).alias("n")).first()
    assert row["n"] == 4_000 and row["learned"] == "".join(f"é \\ text {i}" for i in range(1, 4_000, 2))
