"""Approximate nearest neighbours: a forest of random-projection trees searched through a shared priority queue, then exact reranking.

Fit. Trees are built from a sample of ``sample_rows`` vectors (by hash order), of more for larger tables, so that leaves keep about ``leaf_rows`` vectors, up to
``sample_bytes``; beyond some 16 million vectors of 64 components leaves grow. Each node is a hyperplane between two random points of the node, at the median, so
equal halves go to each side. Every vector is then put in one leaf of each tree.

Search. For each query one priority queue over all trees yields leaves, nearest first (a leaf's distance is the largest margin by which the
path to it was on the wrong side). The first ``probes`` leaves are searched. The number of probes is measured, not guessed: for ``tests`` queries
the exact neighbours among all vectors are computed, and the smallest number is taken that reaches ``recall`` on them.

Rerank. Queries meet the vectors of their leaves by a join on the leaf and are compared exactly, in double precision, in blocks: a leaf of
more vectors or queries than a block holds is dealt to several tasks, so no leaf, however many rows it has, lands in one. Each block
gives the nearest of each query, and these are merged.

Copies. Equal vectors are taken together first and carry their k + 1 smallest ids (all that can ever be among the k nearest), so a vector with
millions of copies is compared once; its ids come back at the end.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and rows without an id, take no part; a shorter vector is filled up
with zeros; repeated rows count once, and a row with the query's id is never its neighbour; fewer candidates than k are all given; ties go to the
smaller id. Only the id and the vector are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """Parameters of index and search."""

    trees: int = 4
    leaf_rows: int = 1_024
    least_leaves: int = 32
    sample_rows: int = 8_192
    leaf_sample: int = 4
    sample_bytes: int = 32 << 20
    tests: int = 96
    recall: float = 0.97
    block_rows: int = 4_096
    block_queries: int = 1_024
    seed: int = 11


class Tree:
    """A complete binary tree: node i has children 2i + 1 and 2i + 2; ``normals`` and ``offsets`` of the inner nodes."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        inner = (1 << depth) - 1
        self.normals, self.offsets = np.zeros((inner, sample.shape[1])), np.zeros(inner)
        self._build(0, sample, rng)

    def _build(self, node: int, points: np.ndarray, rng: np.random.Generator) -> None:
        if node >= len(self.offsets):
            return
        normal = rng.standard_normal(points.shape[1])
        if len(points) > 1:
            a, b = points[rng.choice(len(points), 2, replace=False)]
            normal = a - b if np.any(a != b) else normal
        normal = normal / np.linalg.norm(normal)
        side = points @ normal
        self.normals[node], self.offsets[node] = normal, np.median(side) if len(side) else 0.0
        self._build(2 * node + 1, points[side <= self.offsets[node]], rng)
        self._build(2 * node + 2, points[side > self.offsets[node]], rng)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf number of each point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((points * self.normals[node]).sum(axis=1) > self.offsets[node])
        return node - len(self.offsets)


class Forest:
    """Trees and their common queue."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int):
        self.trees = [Tree(sample, depth, np.random.default_rng(seed + t)) for t in range(trees)]
        self.size = 1 << depth

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf number in the forest (tree * leaves + leaf) per point and tree."""
        return np.stack([t.leaves(points) + i * self.size for i, t in enumerate(self.trees)], axis=1)

    def order(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of the forest in the order of the shared queue."""
        margins = [t.normals @ query - t.offsets for t in self.trees]
        queue = [(0.0, i, 0) for i in range(len(self.trees))]
        out: list[int] = []
        while queue and len(out) < most:
            bound, i, node = heapq.heappop(queue)
            margin = margins[i]
            while node < len(margin):
                right = margin[node] > 0
                heapq.heappush(queue, (max(bound, abs(float(margin[node]))), i, 2 * node + (1 if right else 2)))
                node = 2 * node + (2 if right else 1)
            out.append(node - len(margin) + i * self.size)
        return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow list column, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def nearest(queries: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its k nearest rows by exact distance, ties to the smaller ``least``: query number, row numbers, distances. A matrix product finds
    who can be among them, with room for its rounding."""
    square = (rows ** 2).sum(axis=1)
    for at in range(0, len(queries), 128):
        part = queries[at:at + 128]
        rough = square[None, :] - 2 * part @ rows.T + (part ** 2).sum(axis=1)[:, None]
        room = 1e-9 * (1 + square.max() + (part ** 2).sum(axis=1))
        limit = (np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else rough.max(axis=1)) + room
        for i in range(len(part)):
            near = np.flatnonzero(rough[i] <= limit[i])
            exact = np.sqrt(((rows[near] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((least[near], exact))[:k]
            yield at + i, near[best], exact[best]


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids (``ids``) and a row number (``nth``). Spark keeps k + 1 rows per vector and task before the shuffle."""
    ranked = rows.distinct().withColumn("r", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    grouped = ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return cut_lineage(grouped).withColumn("nth", F.monotonically_increasing_id())


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` (a condition on column ``id``) holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull()).where(usable(F.col("vector")))
    base = distinct_vectors(rows, k)
    n, dims = base.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked = rows.where(is_query).distinct()
    keyed = asked.join(base.select("nth", "vector"), "vector").select(F.col("id").alias("query_id"), "nth")
    keyed = cut_lineage(keyed)
    if not n or keyed.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = cut_lineage(keyed.select("nth").distinct().join(base, "nth").select("nth", "vector"))
    # The forest, from a bounded sample.
    wanted = max(settings.sample_rows, settings.leaf_sample * (n // settings.leaf_rows))
    limit = max(2, min(wanted, settings.sample_bytes // (8 * dims)))
    sample = matrix(base.orderBy(F.xxhash64("nth")).limit(limit).select("vector").toArrow().column(0).combine_chunks(), dims)
    leaves = min(max(settings.least_leaves, n // settings.leaf_rows), max(1, len(sample) // settings.leaf_sample))
    forest = Forest(sample, max(0, int(leaves).bit_length() - 1), settings.trees, settings.seed)
    shared = spark.sparkContext.broadcast(forest)

    def place(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            found = shared.value.leaves(matrix(batch.column("vector"), dims))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "leaves"])

    placed = cut_lineage(base.mapInArrow(place, "vector array<double>, ids array<long>, nth long, leaves array<long>"))
    probes = calibrated(placed, queries, forest, dims, k, settings)

    def visit(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            points = matrix(batch.column("vector"), dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shared.value.order(p, probes) for p in points], pa.list_(pa.int64()))], [*batch.schema.names, "leaves"])

    visited = queries.mapInArrow(visit, "nth long, vector array<double>, leaves array<long>").select("nth", "vector", F.explode("leaves").alias("leaf"))
    visited = cut_lineage(visited)
    stored = placed.select("nth", "vector", F.col("ids")[0].alias("least"), F.explode("leaves").alias("leaf"))
    # Blocks of each leaf, from counts; one row per leaf.
    counts = stored.groupBy("leaf").agg(F.count("*").alias("n")).join(visited.groupBy("leaf").agg(F.count("*").alias("q")), "leaf")
    blocks = F.broadcast(cut_lineage(counts.select("leaf", F.ceil(F.col("n") / settings.block_rows).alias("nb"), F.ceil(F.col("q") / settings.block_queries).alias("qb"))))
    own = F.pmod(F.xxhash64("nth"), F.col("nb")), F.pmod(F.xxhash64("nth"), F.col("qb"))
    left = visited.join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"), own[1].alias("q"), "nth", "vector")
    right = stored.join(blocks, "leaf").select("leaf", own[0].alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("q"), "nth", "vector", "least")

    def compare(asked, held):
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "nth": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        points, rows_ = matrix(asked.column("vector").combine_chunks(), dims), matrix(held.column("vector").combine_chunks(), dims)
        names, numbers, least = asked.column("nth").to_numpy(), held.column("nth").to_numpy(), held.column("least").to_numpy()
        found = list(nearest(points, rows_, least, k + 1))
        return pa.table({"query": np.repeat(names[[i for i, *_ in found]], [len(r) for _, r, _ in found]), "nth": numbers[np.concatenate([r for _, r, _ in found])], "score": np.concatenate([s for *_, s in found])})

    keys = ["leaf", "b", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query long, nth long, score double")
    # Trees find the same vectors; the nearest distinct ones stay, then their ids come back.
    found = cut_lineage(found.distinct())
    first = found.withColumn("least", F.col("nth")).join(base.select("nth", "ids"), "nth").select("query", "ids", "score")
    first = first.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", F.col("ids")[0]))).where(F.col("r") <= k + 1)
    near = cut_lineage(first.select(F.col("query").alias("nth"), F.explode("ids").alias("vec_id"), "score"))
    # Of all ids, a query needs its k + 1 nearest, its own among them at most.
    near = cut_lineage(near.withColumn("r", F.row_number().over(W.partitionBy("nth").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r"))
    answered = keyed.join(near, "nth").where("vec_id <> query_id")
    ranked = answered.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def calibrated(placed: DataFrame, queries: DataFrame, forest: Forest, dims: int, k: int, settings: Settings) -> int:
    """Smallest number of probes that reaches the recall on a bounded set of test queries, whose true neighbours among all vectors are computed."""
    every = len(forest.trees) * forest.size
    tests = queries.orderBy(F.xxhash64("nth")).limit(settings.tests).toArrow()
    points = matrix(tests.column("vector").combine_chunks(), dims)
    shared = placed.sparkSession.sparkContext.broadcast(points)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            numbers, where = batch.column("nth").to_numpy(), batch.column("leaves").to_pylist()
            for i, rows, scores in nearest(shared.value, matrix(batch.column("vector"), dims), numbers, k + 1):
                yield pa.RecordBatch.from_pydict({"query": pa.array([i] * len(rows), pa.int32()), "score": pa.array(scores), "nth": pa.array(numbers[rows]), "leaves": pa.array([where[r] for r in rows], pa.list_(pa.int64()))})

    true = placed.mapInArrow(run, "query int, score double, nth long, leaves array<long>")
    true = true.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", "nth"))).where(F.col("r") <= k + 1).collect()
    place = [{leaf: at for at, leaf in enumerate(forest.order(p, every))} for p in points]
    needed = np.sort([min(place[t["query"]][leaf] for leaf in t["leaves"]) + 1 for t in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(settings.recall * len(needed))))])
