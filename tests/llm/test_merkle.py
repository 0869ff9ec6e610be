"""The manifest against a plain tree: postorder places, logs, proofs over several tiers, odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from carnet.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    """All levels of the tree over ``leaves``, lowest first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain_log(leaves):
    """Postorder by recursion: (level, index, hash)."""
    tree = levels(leaves)

    def walk(level, index):
        if level:
            for child in range(index * 16, min(index * 16 + 16, len(tree[level - 1]))):
                yield from walk(level - 1, child)
        yield level, index, tree[level][index]

    return list(walk(len(tree) - 1, 0))


def plain_proof(leaves, i):
    way = []
    for nodes in levels(leaves)[:-1]:
        run = nodes[i // 16 * 16:i // 16 * 16 + 16]
        way.append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        i //= 16
    return way


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 272, 273, 700, 4096, 4097, 5000])
def test_log_is_postorder(n):
    leaves = [h(str(i)) for i in range(n)]
    want = plain_log(leaves)
    height = merkle.tree_height(n)
    assert merkle.build(leaves, height) == [node for *_, node in want]
    for at, (level, index, _) in enumerate(want):
        assert merkle.position(level, index, n, height) == at
    log = merkle.build(leaves, height)
    for i in {0, n // 2, n - 1}:
        way = merkle.way_of(log, n, height, i, [])
        assert way == plain_proof(leaves, i) and merkle.fold(leaves[i], way) == want[-1][2]
        assert n == 1 or merkle.fold(h("other"), way) != want[-1][2]


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) per row, by the definition."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots = []
    for name in names:
        groups[name].sort(key=lambda g: g[:3])
        subroots.append(levels([g[2] for g in groups[name]])[-1][0])
    out, top = [], levels(subroots)[-1][0]
    for s, name in enumerate(names):
        leaves = [g[2] for g in groups[name]]
        for i, (*_, leaf, row) in enumerate(groups[name]):
            way = plain_proof(leaves, i) + plain_proof(subroots, s)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = plain_leaf((*row[:4], lower(row[4]))) if changed else leaf
            for left, right in way:
                folded = h(left, folded, right)
            out.append((row[0], leaf, subroots[s], top, h(*[x + y for x, y in way]), folded, folded == top))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def answer(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, rng.choice(["hot"] * 8 + [f"s{k}" for k in range(20)] + ["é", "Z", "", None]), rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["Some Text", "low", "ÀB", "", None])) for i in range(1200)]
    out += [(None, "hot", "en", 3, "No Id"), (None, None, None, None, None), (None, "hot", "en", 3, "No Id"), out[5], out[5], (7, "hot", "x", 1, "Other"), (10_000, "hot", "en", 9, "Long " * 100_000)]
    out += [(-5, "one", None, None, "A")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("height", [1, 3])
def test_whole_manifest(spark, rows, height):
    """Pages of 16 leaves need three tiers, pages of 4,096 one."""
    docs = table(spark, rows).withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("__part", F.lit(0)).repartition(5)
    built = merkle.manifest(docs, height=height)
    assert len(built.pages) == (3 if height == 1 else 1)
    want = plain_manifest(rows)
    assert answer(built.proofs()) == sorted(want, key=str)
    assert {v for *_, v in want} == {True, False}


@pytest.mark.parametrize("height", [1, 2])
def test_stored_log(spark, rows, height):
    built = merkle.manifest(table(spark, rows), height=height)
    got = {}
    for r in built.log().collect():
        got.setdefault(r["source"], []).append((r["position"], (r["level"], r["index"], r["hash"])))
    leaves = {}
    for r in built.leaves.orderBy("i").collect():
        leaves.setdefault(r["source"], []).append(r["leaf"])
    assert set(got) == set(leaves)
    for source, lines in got.items():
        want = plain_log(leaves[source])
        assert sorted(lines, key=lambda x: x[0]) == list(enumerate(want))


def test_small_and_empty(spark):
    assert answer(merkle.manifest(table(spark, []).limit(0)).proofs()) == []
    for rows in ([(1, "a", "en", 2, "Hi")], [(1, None, None, None, None)], [(2, "a", "en", 2, "Hi"), (1, "a", "en", 2, "Hi")], [(2, "a", "en", 2, "Hi"), (1, "b", "en", 2, "Hi")]):
        assert answer(merkle.manifest(table(spark, rows)).proofs()) == sorted(plain_manifest(rows), key=str)
