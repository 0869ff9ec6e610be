"""SimHash against a plain count of bits and all-pairs links on small tables."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from carnet.llm import simhash

MASK = (1 << 64) - 1


def plain_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict) -> dict:
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_of_odd_texts():
    for text in ("", " \t\n", "One", "one two", "A b C d A b C d", "é x\x85y z É", "a " * 5000):
        assert simhash.fingerprint_of(text.encode()) == plain_fingerprint(text), text


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("most", [1 << 21, 20_000])
def test_components_of_planted_fingerprints(spark, most):
    """Chains, stars and a dense cloud around one value, also with buckets so small that they are split again."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:12]:
        for d in (1, 2, 3, 4):
            value = base
            for bit in rng.sample(range(64), d):
                value ^= 1 << bit
            fps.append(value)
    for _ in range(200):
        value = fps[0]
        for bit in rng.sample(range(64), rng.choice((1, 2, 3, 5))):
            value ^= 1 << bit
        fps.append(value)
    chain = rng.getrandbits(64)
    for step in range(12):
        chain ^= 7 << (5 * step)
        fps.append(chain)
    fps = sorted(set(fps))
    expected = plain_components(dict(enumerate(fps)))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, most=most)).collect()}
    groups, plain = {}, {}
    for i, f in enumerate(fps):
        groups.setdefault(found.get(signed(f), signed(f)), set()).add(i)
        plain.setdefault(expected[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_links_stay_few_in_a_dense_group(spark):
    """All 2081 values within two bits of one give no more links than buckets times members, and one component."""
    values = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash.links(df, most=200_000)
    assert links.count() < 60 * len(values)
    roots = simhash.components(links)
    assert roots.count() == len(values) and roots.select("root").distinct().count() == 1


def test_documents_with_nulls_copies_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, 1), (9, base.upper(), 2), (7, base + " tail", 3), (3, None, 4), (4, "", 5), (4, "", 6), (None, base, 7), (11, "short", 8), (12, "x " * 30_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {}
    for i, (_, text, _) in enumerate(rows):
        fps[i] = plain_fingerprint(text)
    assert sorted(r["fp"] for r in got) == sorted(signed(f) for f in fps.values())
    comps = plain_components(fps)
    least = {c: min(rows[i][0] for i in comps if comps[i] == c and rows[i][0] is not None) for c in set(comps.values())}
    want = sorted((str(rows[i][0]), least[comps[i]]) for i in comps)
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, sf_dir):
    from carnet.llm import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    comps = plain_components(dict(sorted(fps.items())))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", comps[i]) for i in fps}
