"""Centroid clustering with ns-bounds: exact rounds of nearest centroid and mean, most distances spared by bounds that remember when they were taken.

Bounds. Each vector keeps, per centroid, a lower bound of its distance to it and the round in which that was evaluated; for its own centroid an upper bound.
The history of all centroids is kept. In a later round a bound is loosened by the norm of the centroid's total displacement since then, one
straight line from the old place to the new, and not by the sum of what it moved round by round, which is never shorter. A centroid whose lower
bound exceeds the upper bound of the vector's own can neither be nearer nor tie. The others fail: first the own distance is evaluated, then
exactly those that still fail, and the nearest is chosen among evaluated distances, ties to the smaller number. Bounds are kept in single precision
and widened beyond its rounding, distances are integers, so the clusters are those of comparing everything.

State. One row per vector (components, cluster, bounds, rounds; after the last round the exact distance), written as Parquet every round in the shared folder and
dealt by splits of the file, never by cluster, so no cluster however large meets in one task. A round sends one sum per cluster and task; centroids
and their history (``k`` vectors a round) are all that the driver holds.

Defined cases: vectors that are null, have another number of components or hold a null, NaN or infinite component are left out; components are
floor(scale x), saturated at 2^27 in size so that a squared distance is a long, as sums of distances are at 2^63 - 1; repeated rows are vectors of their own, and may start as equal centroids, of
which the smaller number wins; rows without an id are clustered but are the last to start a centroid; with fewer vectors than ``k`` there are as many
centroids as vectors; an empty table has no clusters. Only the id and the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.session import drop_path, work_path

#: Components stay below this size, distances below 2^62.
MOST = 1 << 27
#: What a bound in single precision may be off, with room.
ROOM = 1e-6
STATE = "vec_id long, vector binary, cluster int, distance long, bounds binary, rounds binary"


@dataclass(frozen=True)
class Settings:
    """Parameters of the clustering."""

    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: float = 256.0
    seed: int = 2


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def integers(vector: Column, scale: float) -> Column:
    """Components floor(scale * x), saturated."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))


def distances(points: np.ndarray, centres: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs (row, centroid)."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 1 << 15):
        gap = points[rows[at:at + (1 << 15)]] - centres[which[at:at + (1 << 15)]]
        out[at:at + (1 << 15)] = (gap * gap).sum(axis=1)
    return out


class Step:
    """One round of assignment: the centroids of every round so far, and their displacements up to now."""

    def __init__(self, history: np.ndarray):
        self.centres, self.now = history[-1], len(history) - 1
        moved = (history - history[-1][None]).astype(np.float64)
        self.drift = np.sqrt((moved * moved).sum(axis=2)).T * (1 + ROOM)  # centroid, round of evaluation
        self.k = len(self.centres)

    def start(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters, bounds and rounds of new vectors; every distance is evaluated."""
        n, k = len(points), self.k
        exact = distances(points, self.centres, np.repeat(np.arange(n), k), np.tile(np.arange(k), n)).reshape(n, k)
        cluster = exact.argmin(axis=1)  # the first of equals
        return cluster, np.sqrt(exact.astype(np.float64)).astype(np.float32), np.full((n, k), self.now, np.uint8)

    def renew(self, points: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, int]:
        """Clusters of the vectors now; bounds and rounds of what had to be evaluated are renewed in place. Also the number of evaluated distances.
        ``bounds`` of a vector's own centroid is its distance when evaluated, above and below."""
        n, each = len(points), np.arange(len(points))
        loosened = self.drift[np.arange(self.k)[None, :], rounds]
        low = bounds.astype(np.float64) * (1 - ROOM) - loosened
        own = cluster.copy()
        high = bounds[each, own].astype(np.float64) * (1 + ROOM) + loosened[each, own]
        low[each, own] = np.inf
        doubtful = np.flatnonzero((low <= high[:, None]).any(axis=1))
        if not len(doubtful):
            return own, 0
        square = distances(points, self.centres, doubtful, own[doubtful])
        bounds[doubtful, own[doubtful]], rounds[doubtful, own[doubtful]] = np.sqrt(square.astype(np.float64)), self.now
        failing = low[doubtful] <= (np.sqrt(square.astype(np.float64)) * (1 + ROOM))[:, None]
        at, which = np.nonzero(failing)
        if not len(at):
            return own, len(doubtful)
        found = distances(points, self.centres, doubtful[at], which)
        bounds[doubtful[at], which], rounds[doubtful[at], which] = np.sqrt(found.astype(np.float64)), self.now
        # Of all evaluated centroids of a vector the nearest, ties to the smaller number.
        rows = np.concatenate([np.arange(len(doubtful)), at])
        names = np.concatenate([own[doubtful], which])
        values = np.concatenate([square, found])
        order = np.lexsort((names, values, rows))
        first = np.concatenate(([True], rows[order][1:] != rows[order][:-1]))
        own[doubtful] = names[order][first]
        return own, len(doubtful) + len(found)


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of equal binary cells as a matrix of their own memory."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width).copy()


def _cells(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _assigner(history: np.ndarray, dims: int, last: bool):
    """Task of one round. The first round has vectors only; the last one gives the distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Step(history)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column("vector"), np.int32, dims).astype(np.int64)
            if step.now:
                cluster, bounds, rounds = batch.column("cluster").to_numpy().astype(np.int64), _matrix(batch.column("bounds"), np.float32, step.k), _matrix(batch.column("rounds"), np.uint8, step.k)
                cluster, _ = step.renew(points, cluster, bounds, rounds)
            else:
                cluster, bounds, rounds = step.start(points)
            square = pa.array(distances(points, step.centres, np.arange(len(points)), cluster)) if last else pa.nulls(len(points), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32()), square, _cells(bounds), _cells(rounds)],
                                             ["vec_id", "vector", "cluster", "distance", "bounds", "rounds"])

    return run


def _summer(k: int, dims: int):
    """Task that sums its vectors by cluster: one row per cluster met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster").to_numpy()
                order = np.argsort(cluster, kind="stable")
                names, first = np.unique(cluster[order], return_index=True)
                totals[names] += np.add.reduceat(_matrix(batch.column("vector"), np.int32, dims)[order].astype(np.int64), first, axis=0)
                counts += np.bincount(cluster, minlength=k)
        met = np.flatnonzero(counts)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(totals[met].tolist(), pa.list_(pa.int64()))], ["cluster", "rows", "total"])

    return run


def means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The next centroids: componentwise floor(sum / count) of each cluster, the old place for empty ones. One sum per cluster and task is
    added up on Spark, then ``k`` vectors are fetched."""
    k, dims = centres.shape
    out = centres.copy()
    parts = state.select("cluster", "vector").mapInArrow(_summer(k, dims), "cluster int, rows long, total array<long>")
    sums = parts.select("cluster", "rows", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at")
    for r in sums.agg(F.sum("rows").alias("rows"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["at"]] = int(r["total"]) // r["rows"]
    return out


@dataclass(frozen=True)
class Clusters:
    """Result: ``rows`` (vec_id, cluster, distance) and the final centroids."""

    rows: DataFrame
    centres: np.ndarray


def first_centres(rows: DataFrame, settings: Settings) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in that order."""
    name = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.select(name.alias("name"), "numbers").orderBy(F.col("name").asc_nulls_last(), "numbers").limit(settings.k).collect()
    return np.array([r["numbers"] for r in chosen], np.int64).reshape(len(chosen), settings.dims)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of components as binary cells."""
    for batch in batches:
        lists = batch.column("numbers")
        flat = lists.flatten().to_numpy().astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _cells(flat.reshape(batch.num_rows, -1)) if batch.num_rows else pa.array([], pa.binary())], ["vec_id", "vector"])


def cluster(vectors: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Cluster all usable vectors: rounds of assignment and means, then one more assignment."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v"), settings.dims))
    kept = kept.select("vec_id", integers(F.col("v"), settings.scale).alias("numbers"))
    centres = first_centres(kept, settings)
    if not len(centres):
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centres)
    history, state, before = [centres], kept.mapInArrow(packed, "vec_id long, vector binary"), None
    for now in range(settings.rounds + 1):
        path = work_path(spark, f"centroids-{now}")
        state.mapInArrow(_assigner(np.stack(history), settings.dims, now == settings.rounds), STATE).write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
        if now < settings.rounds:
            history.append(means(state, history[-1]))
    return Clusters(state.select("vec_id", "cluster", "distance"), history[-1])


def digest(centre: np.ndarray) -> str:
    """Lower-case hex SHA-256 of a centroid's components, joined by commas."""
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode("ascii")).hexdigest()


def described(found: Clusters) -> DataFrame:
    """Every vector with the sums of distances of its cluster and of all, and its centroid's digest. The joined side has one row per centroid."""
    most = (1 << 63) - 1
    sums = {r[0]: int(r[1]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    facts = found.rows.sparkSession.createDataFrame([(i, min(s, most), digest(found.centres[i])) for i, s in sums.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    whole = F.lit(min(sum(sums.values()), most)).cast("long")
    return found.rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", whole.alias("inertia"), "centroid_sha256")
