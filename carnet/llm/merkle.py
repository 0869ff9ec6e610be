"""Merkle manifest of a dataset: one 16-ary tree per source and one over the sources, kept as a postorder append log.

Log. A builder takes its leaves in order and appends every node when it is complete: a leaf at once, an inner node right behind its last child. The place
of a node in such a log follows from the sizes of the subtrees before it alone (:func:`position`), so nothing but the hashes is stored, and a
sibling is addressed without an index.

Aligned builders. Leaves are numbered inside their source, and every ``16 ** height`` of them, counted from a multiple of that, are one builder's page: a
complete subtree that no other builder touches. The roots of a source's pages are the leaves of its next tier, until one page is left; its root is
the source's subroot. Subroots, in the order of their sources, are the leaves of one more tree, built the same way, whose root stands for the dataset.

Proofs. Pages are read from the top tier down. Each hands to the pages under its leaves the siblings on the way to the root; a page of
the lowest tier adds its own, read from its log by position. A page and the way above it (15 siblings a level) are all that a task holds at a time.

Numbers inside a source. Rows are range-partitioned by source and id, and counted per source and partition; a partition's rows start behind the
rows of their source in earlier partitions. A source of any size is dealt over many partitions and pages.

Defined cases: every column may be null; null sources are one source, the first; rows without an id come first in their source; rows of one id
follow the hash of their leaf; repeated rows are leaves of their own; a source of one leaf has that leaf as its subroot, and one source's subroot is the root;
an empty table has no leaves and no proofs. A row without an id is never tampered with. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet.llm.common import lower_ascii
from carnet.session import cut_lineage

#: Children of a node, and levels of a builder's page: 4,096 leaves.
FAN, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5
PAGE = "tree long, block long, n long, leaves long, height int, nodes binary, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, leaf_no long"


def digest(*parts: str) -> str:
    """Lower-case hex SHA-256 of the parts' texts, one after the other."""
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def tree_height(leaves: int) -> int:
    """Levels above the leaves of a tree that ends in one node."""
    height = 0
    while FAN ** height < leaves:
        height += 1
    return height


def position(level: int, index: int, leaves: int, height: int) -> int:
    """Place in the log of node ``index`` of a level, for a tree of that many leaves and levels. The node is complete once ``last`` leaves are there; all
    nodes up to its level that cover them precede it, and of the higher ones those that were complete one leaf before."""
    last = min((index + 1) * FAN ** level, leaves)
    below = sum(-(-last // FAN ** k) for k in range(level + 1))
    above = sum((last - 1) // FAN ** k for k in range(level + 1, height + 1))
    return below + above - 1


def width(level: int, leaves: int) -> int:
    """Nodes of a level."""
    return -(-leaves // FAN ** level)


def children(level: int, run: int, leaves: int, height: int) -> list[int]:
    """Places in the log of the nodes of one run of a level."""
    return [position(level, i, leaves, height) for i in range(run * FAN, min(run * FAN + FAN, width(level, leaves)))]


def build(leaves: Sequence[str], height: int) -> list[str]:
    """The log of a tree, appended in the order of completion."""
    log: list[str] = []
    for done, leaf in enumerate(leaves, 1):
        log.append(leaf)
        level = 1
        while level <= height and (done == len(leaves) or done % FAN ** level == 0):
            run = width(level, done) - 1
            log.append(digest(*(log[at] for at in children(level - 1, run, len(leaves), height))))
            level += 1
    return log


def sides(log: Sequence[str], leaves: int, height: int, level: int, index: int) -> tuple[str, str]:
    """Siblings to the left and right of a node, joined."""
    run = [log[at] for at in children(level, index // FAN, leaves, height)]
    return "".join(run[:index % FAN]), "".join(run[index % FAN + 1:])


def fold(leaf: str, way: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for left, right in way:
        leaf = digest(left, leaf, right)
    return leaf


def pack(log: Sequence[str]) -> bytes:
    return bytes.fromhex("".join(log))


def unpack(nodes: bytes) -> list[str]:
    text = nodes.hex()
    return [text[at:at + 64] for at in range(0, len(text), 64)]


def way_of(log: Sequence[str], leaves: int, height: int, index: int, above: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Siblings of a leaf of a page, level by level, and those above the page."""
    return [sides(log, leaves, height, level, index // FAN ** level) for level in range(height)] + list(above)


# --- leaves ----------------------------------------------------------------------------------------------------------------------

def leaf_hash(*values: Column) -> Column:
    """H of values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def leaves_of(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Rows (doc_id, source, leaf, tampered): the leaf of each row, and the leaf it would have with its text's capitals made small, if it is one
    of the rows to tamper with (else null)."""
    doc_id, source, *_, text = (F.col(f) for f in fields)
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % TAMPER == 0
    changed = leaf_hash(*[F.col(f) for f in fields[:-1]], lower_ascii(text))
    return docs.select(doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), leaf_hash(*[F.col(f) for f in fields]).alias("leaf"), F.when(chosen, changed).alias("tampered"))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number from 0 of each row inside its group along ``order``, and the group's rows (``n``). Equal rows keep the order they are stored in."""
    stored = cut_lineage(rows).withColumn("__tie", F.monotonically_increasing_id())
    by = [*group, *order, "__tie"]
    placed = stored.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("__g", F.struct(*group) if group else F.struct(F.lit(0).alias("all"))))
    runs = placed.groupBy("__g", "__part").agg(F.count("*").alias("rows"), F.min("__at").alias("first"))
    before = W.partitionBy("__g").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("__g", "__part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"), F.sum("rows").over(W.partitionBy("__g")).alias("n"))
    return placed.join(runs, ["__g", "__part"]).withColumn(name, F.col("__at") - F.col("first") + F.col("earlier")).drop("__g", "__part", "__at", "__tie", "first", "earlier")


# --- building --------------------------------------------------------------------------------------------------------------------

def _builder(height: int):
    """Task that makes the page of one block. The only page of a tree ends in its root, however low; all others have the full height."""

    def make(key, table):
        table = table.sort_by("i")
        leaves, whole = table.column("hash").to_pylist(), table.column("n")[0].as_py()
        tall = tree_height(whole) if whole <= FAN ** height else height
        log = build(leaves, tall)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([whole], pa.int64()), "leaves": pa.array([len(leaves)], pa.int64()),
                         "height": pa.array([tall], pa.int32()), "nodes": pa.array([pack(log)], pa.binary()), "root": [log[-1]]})

    return make


def tiers(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Stored pages of every tier, lowest first, from rows (tree, i, n, hash): leaf ``i`` of ``n`` in a tree. The last tier has one page per tree; a
    tree that ended in an earlier tier is passed on as a page of that one leaf."""
    out: list[DataFrame] = []
    span = FAN ** height
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most:
        blocks = nodes.withColumn("block", (F.col("i") / span).cast("long"))
        pages = cut_lineage(blocks.groupBy("tree", "block").applyInArrow(_builder(height), PAGE))
        out.append(pages)
        if most <= span:
            break
        most = -(-most // span)
        nodes = pages.select("tree", F.col("block").alias("i"), F.ceil(F.col("n") / span).alias("n"), F.col("root").alias("hash"))
    return out


@dataclass(frozen=True)
class Manifest:
    """Trees of a dataset. ``leaves``: rows (tree, i, n, source, doc_id, leaf, tampered); ``pages``: the tiers of the sources' trees; ``top``: those of the tree
    over their subroots; ``root``: its root, None without rows."""

    leaves: DataFrame
    pages: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    height: int

    def subroots(self) -> DataFrame:
        """Rows (tree, subroot)."""
        return self.pages[-1].select("tree", F.col("root").alias("subroot"))

    def log(self) -> DataFrame:
        """Rows (source, position, level, index, hash): the append log of every source's tree, in the order of completion."""
        height, parts = self.height, []
        for tier, pages in enumerate(self.pages):
            def spread(batches, tier=tier):
                for batch in batches:
                    for row in batch.to_pylist():
                        log = unpack(row["nodes"])
                        n, tall = row["all"], tree_height(row["all"])
                        lines = []
                        for level in range(row["height"] + 1) if tier == 0 else range(1, row["height"] + 1):
                            for i in range(width(level, row["leaves"])):
                                index = row["block"] * FAN ** (height - level) + i
                                lines.append((row["source"], position(level + tier * height, index, n, tall), level + tier * height, index, log[position(level, i, row["leaves"], row["height"])]))
                        names = ["source", "position", "level", "index", "hash"]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*lines) if lines else [()] * 5, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names)

            named = pages.join(self.sources(), "tree")
            parts.append(named.mapInArrow(spread, "source string, position long, level int, index long, hash string"))
        return reduce(DataFrame.unionByName, parts)

    def sources(self) -> DataFrame:
        """Rows (tree, source, all): number of a source in order, its name and its leaves."""
        return self.leaves.groupBy("tree").agg(F.first("source").alias("source"), F.max("n").alias("all"))

    def proofs(self) -> DataFrame:
        """Rows ``PROOF``: per leaf its proof, and what the tampered (else the original) leaf folds to with the original siblings."""
        if self.root is None:
            return self.leaves.sparkSession.createDataFrame([], PROOF)
        above = _descend(self.top, None, self.height).select(F.col("block").alias("tree"), "way").join(self.subroots(), "tree").withColumn("block", F.lit(0).cast("long"))
        if len(self.pages) > 1:
            above = _descend(self.pages[1:], above, self.height)
        ready = self.pages[0].select("tree", "block", "leaves", "height", "nodes").join(above, ["tree", "block"])
        rows = self.leaves.withColumn("block", (F.col("i") / FAN ** self.height).cast("long"))
        keys = ["tree", "block"]
        return rows.groupBy(*keys).cogroup(ready.groupBy(*keys)).applyInArrow(_prover(self.root), PROOF)


WAY = "array<struct<left: string, right: string>>"
_WAY = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _pairs(way) -> list[tuple[str, str]]:
    return [(s["left"], s["right"]) for s in way]


def _structs(way) -> list[dict]:
    return [{"left": left, "right": right} for left, right in way]


def _descend(pages: list[DataFrame], above: DataFrame | None, height: int) -> DataFrame:
    """Rows (tree, block, way, subroot): the siblings above each leaf of the lowest of these tiers, as the page of that number one tier down needs them.
    ``above`` has them for the one page of each tree in the last tier; without it, nothing is above."""

    def hand_down(batches):
        for batch in batches:
            for row in batch.to_pylist():
                log, over = unpack(row["nodes"]), _pairs(row["way"])
                first = row["block"] * FAN ** height
                ways = [_structs(way_of(log, row["leaves"], row["height"], i, over)) for i in range(row["leaves"])]
                n = len(ways)
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(ways, _WAY), pa.array([row["subroot"]] * n, pa.string())],
                                                 ["tree", "block", "way", "subroot"])

    for tier in reversed(pages):
        held = tier.select("tree", "block", "leaves", "height", "nodes")
        held = held.join(above, ["tree", "block"]) if above is not None else held.withColumn("way", F.array().cast(WAY)).withColumn("subroot", F.lit(None).cast("string"))
        above = cut_lineage(held.mapInArrow(hand_down, f"tree long, block long, way {WAY}, subroot string"))
    return above


def _prover(root: str):
    def prove(rows, page):
        if not rows.num_rows or not page.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(_PROOF_NAMES, _PROOF_TYPES)})
        rows = rows.sort_by("i")
        held = page.to_pylist()[0]
        log, over, leaves, height = unpack(held["nodes"]), _pairs(held["way"]), held["leaves"], held["height"]
        found, tampered = rows.column("leaf").to_pylist(), rows.column("tampered").to_pylist()
        proofs, folded = [], []
        for run in range(width(1, leaves)):  # the leaves of a run share what is above it
            upper = way_of(log, leaves, height, run * FAN, over)[1:] if height else over
            rest = "".join(left + right for left, right in upper)
            peers = [log[at] for at in children(0, run, leaves, height)]
            for at in range(len(peers)):
                own = [("".join(peers[:at]), "".join(peers[at + 1:]))] if height else []
                proofs.append(digest(*(left + right for left, right in own), rest))
                folded.append(fold(tampered[run * FAN + at] or found[run * FAN + at], own + upper))
        n = len(found)
        columns = (rows.column("doc_id").to_pylist(), found, [held["subroot"]] * n, [root] * n, proofs, folded, [f == root for f in folded], rows.column("source").to_pylist(), rows.column("i").to_pylist())
        return pa.table({name: pa.array(c, t) for name, c, t in zip(_PROOF_NAMES, columns, _PROOF_TYPES)})

    return prove


_PROOF_NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source", "leaf_no")
_PROOF_TYPES = (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.string(), pa.int64())


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, height: int = HEIGHT) -> Manifest:
    """Build all trees of ``docs``; ``fields`` name the id, the source, further columns and, last, the text."""
    rows = numbered(leaves_of(docs, fields), ["source"], ["doc_id", "leaf"], "i")
    rows = cut_lineage(rows)
    names = numbered(rows.where("i = 0").select("source", F.col("n").alias("leaves")), [], ["source"], "tree").select(F.col("source").alias("name"), "tree")
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = cut_lineage(rows)
    pages = tiers(rows.select("tree", "i", "n", F.col("leaf").alias("hash")), height)
    if not pages:
        return Manifest(rows, [], [], None, height)
    count = F.lit(pages[-1].count()).cast("long")
    top = tiers(pages[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), count.alias("n"), F.col("root").alias("hash")), height)
    return Manifest(rows, pages, top, top[-1].first()["root"], height)
