"""SimHash near-duplicates: meet-in-the-middle ball hashing on 64-bit fingerprints.

Fingerprint. Words are runs of anything but ASCII white space, A-Z in lower case; a shingle is ``words`` consecutive words, repeats included (a shorter
text is one shingle, a text without words has fingerprint zero). A bit is set if it is set in over half of the shingles' XXH64 hashes.

Links at up to 3 differing bits, exactly, without listing pairs. Every fingerprint emits the variants within half the radius that
have an even number of set bits: an odd one its 64 neighbours at distance 1, an even one itself and its 2016 neighbours at distance 2. Two fingerprints
within 3 bits always share such a variant. A variant that no fingerprint meets within distance 1 proves nothing; on any other, the
first such fingerprint (the anchor) is within 3 bits of all that share the variant, so links to the anchor join the whole
group, and each is verified by its distance. Copies are taken together first: only distinct fingerprints emit.

The shuffle on variants moves fingerprints, not variants: variants are dealt out by their leading bits, a fingerprint goes to the buckets that
its variants can reach (1 + b + b(b-1)/2 for b bits), and the variants inside a bucket are made and matched there in numpy. b grows with the
number of fingerprints; a bucket with more than ``most`` variants is split by further bits until it is small enough, so a dense
neighbourhood is spread over many tasks. A bucket gives at most one link per fingerprint in it.

Components. Links are contracted round by round: every node points to its smallest neighbour, pointers are doubled, links are renamed, until none
is left. Nodes halve at least in each round, and all steps are joins and aggregates.

Defined cases: a null text has no words; repeated rows are rows of their own in one component; rows without an id take part, and a component of
such rows only has a null id; an empty table has no components. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carnet.llm.common import fresh, text_bytes
from carnet.session import cut_lineage

WORDS = 3
SEED = 42
#: Variants that one bucket may hold; on average it holds an eighth.
MOST = 1 << 21
#: Bits by which a bucket with more is split further.
STEP = 8


def fingerprint_of(text: bytes, words: int = WORDS) -> int:
    """Fingerprint of a text in UTF-8."""
    # Only the bytes of A-Z change, and bytes are split at ASCII white space.
    parts = text.lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else (b" ".join(parts),)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at:at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """Fingerprint as a signed long; null texts have no words."""
    @F.arrow_udf(T.LongType())
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())

    return compute.asNondeterministic()(text_bytes(text))


# --- buckets of variants -------------------------------------------------------------------------------------------------------

ROW = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("left", T.IntegerType())])


def _split(bits_before: int, bits: int):
    """Task that sends each row to the buckets its variants reach when ``bits`` more leading bits are fixed. ``left`` is the number of
    flips a variant has beyond the leading bits, at most; the flips of an odd fingerprint are 1, those of an even one 0 or 2."""
    # Flip patterns by number of flips.
    masks = {0: np.zeros(1, np.uint64), 1: np.uint64(1) << np.arange(bits, dtype=np.uint64)}
    masks[2] = np.array([masks[1][i] | masks[1][j] for i in range(bits) for j in range(i)], np.uint64)
    below = np.uint64(64 - bits_before - bits)
    room = 64 - bits_before - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                bucket, fp = (part.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("bucket", "fp"))
                left = part.column("left").to_numpy(zero_copy_only=False)
                low = (fp >> below) & np.uint64((1 << bits) - 1)
                out = []
                for flips, pattern in masks.items():
                    for have in range(flips, 3):
                        # Flips left over must fit: an exact number for odd and even totals is checked where variants are made.
                        mine = left == have
                        if not mine.any() or (have - flips > room):
                            continue
                        keys = ((bucket[mine] << np.uint64(bits)) | low[mine])[:, None] ^ pattern[None, :]
                        out.append((keys.ravel(), np.repeat(fp[mine], len(pattern)), np.full(keys.size, have - flips, np.int32)))
                for keys, fps, rest in out:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(rest)], ["bucket", "fp", "left"])

    return run


def _variants(fp: np.ndarray, left: np.ndarray, room: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants inside a bucket and the index of the row each comes from. ``prefix`` holds the fixed leading bits."""
    low_mask = np.uint64((1 << room) - 1) if room < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    base = prefix | (fp & low_mask)
    one = np.uint64(1) << np.arange(room, dtype=np.uint64)
    i, j = np.triu_indices(room, 1)
    two = one[i] | one[j]
    keys, rows = [], []
    for have, pattern in ((0, np.zeros(1, np.uint64)), (1, one), (2, two)):
        mine = np.flatnonzero(left == have)
        if len(mine) and len(pattern):
            keys.append((base[mine][:, None] ^ pattern[None, :]).ravel())
            rows.append(np.repeat(mine, len(pattern)))
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes, by repeated pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    return root


def _linker(depth: int):
    """Task that matches the variants of each whole bucket and gives a spanning set of links, one row per linked fingerprint."""
    room = 64 - depth

    def link(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        left = table.column("left").to_numpy()
        prefix = (np.full(len(fp), key[0].as_py(), np.int64).view(np.uint64) << np.uint64(room)) if room < 64 else np.zeros(len(fp), np.uint64)
        keys, rows = _variants(fp, left, room, prefix)
        # Anchors first among equals: variants at distance 0 or 1 from their fingerprint.
        far = np.bitwise_count(keys ^ fp[rows]) > 1
        near_keys = np.unique(keys[~far])
        if len(near_keys):
            at = np.minimum(np.searchsorted(near_keys, keys), len(near_keys) - 1)
            met = near_keys[at] == keys
            keys, rows, far = keys[met], rows[met], far[met]
        else:
            keys, rows, far = keys[:0], rows[:0], far[:0]
        order = np.lexsort((far, keys))
        keys, rows = keys[order], rows[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        anchor = rows[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(keys) else rows
        true = (fp[rows] != fp[anchor]) & (np.bitwise_count(fp[rows] ^ fp[anchor]) <= 3)
        _, number = np.unique(fp, return_inverse=True)
        root = _roots(int(number.max()) + 1, number[rows[true]], number[anchor[true]])
        distinct = np.unique(fp)
        moved = np.flatnonzero(root != np.arange(len(distinct)))
        return pa.table({"a": pa.array(distinct[moved].view(np.int64)), "b": pa.array(distinct[root[moved]].view(np.int64))})

    return link


def links(fingerprints: DataFrame, fp: str = "fp", most: int = MOST) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints at up to 3 differing bits. ``fingerprints`` must be distinct."""
    # The distances of variants: 1 for odd fingerprints, 0 and 2 for even ones, each its own row.
    lefts = F.when(F.bit_count(F.col(fp)) % 2 == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))
    rows = fingerprints.select(F.lit(0).cast("long").alias("bucket"), F.col(fp).alias("fp"), F.explode(lefts).alias("left"))
    bits = max(1, min(24, (fingerprints.count() * 1040 * 8 // most).bit_length()))
    depth, found = 0, None
    while True:
        rows = rows.mapInArrow(_split(depth, bits), ROW)
        depth += bits
        bits, room = min(STEP, 64 - depth), 64 - depth
        variants = F.sum(F.element_at(F.array(*[F.lit(float(k)) for k in (1, room, room * (room - 1) // 2)]), F.col("left") + 1))
        heavy = cut_lineage(rows.groupBy("bucket").agg(variants.alias("n")).where(F.col("n") > most).select("bucket")) if bits else None
        split = heavy is not None and not heavy.isEmpty()
        small = rows.join(heavy, "bucket", "left_anti") if split else rows
        part = cut_lineage(small.groupBy("bucket").applyInArrow(_linker(depth), "a long, b long").distinct())
        found = part if found is None else found.unionByName(part)
        if not split:
            return found
        rows = cut_lineage(rows.join(heavy, "bucket", "left_semi"))


# --- components ------------------------------------------------------------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node that has a link; root is one node of its component, the same for all."""
    edges = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"))
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).withColumn("p", F.least("node", "p"))
        for _ in range(2):  # pointers of pointers
            low = cut_lineage(low)
            up = low.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            low = low.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"))
        low = cut_lineage(low)
        labels = low.select("node", F.col("p").alias("root")) if labels is None else labels.join(low.select(F.col("node").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = cut_lineage(labels)
        one, two = low.select(F.col("node").alias("a"), F.col("p").alias("pa")), low.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        edges = cut_lineage(edges.join(one, "a").join(two, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (fp, root) of all distinct fingerprints of ``rows``; root is the same for all of a component."""
    distinct = cut_lineage(rows.select("fp").distinct())
    roots = components(links(distinct, most=most)).withColumnRenamed("node", "fp")
    return cut_lineage(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per document; component_id is the smallest id of the documents linked to it, directly or not."""
    rows = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(rooted(rows, most), "fp")
    firsts = cut_lineage(firsts)
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(firsts.join(least, "root").select("fp", "component_id"), "fp")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The documents without near-duplicates: of each component the row of the smallest id stays (a row without id only if none has one; of
    repeated rows one). Columns are those of ``docs``. Texts move once, to meet the rows that stay."""
    key, nth = fresh(docs, "key"), fresh(docs, "nth")
    identity = F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    rows = cut_lineage(docs.select(identity.alias("key"), fingerprint(F.col(text)).alias("fp")))
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("key.doc_id").isNull().alias("last"), "key")).alias("best"))
    best = best.join(rooted(rows, most), "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias(key))
    met = docs.withColumn(key, identity).join(best, key, "left_semi")
    return met.withColumn(nth, F.row_number().over(W.partitionBy(key).orderBy(key))).where(F.col(nth) == 1).select(docs.columns)
