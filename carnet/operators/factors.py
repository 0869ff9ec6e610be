"""Factor analyses: principal components, multiple correspondence, mixed data, by subspace iteration on sparse rows.

A row is a list of (slot, value) pairs; a category is one slot, so a column of many categories adds slots and no columns. Slots are numbered by a distributed
dictionary and met by joins (broadcast up to a measured size). The leading axes come from block power iteration: every pass multiplies the centred
rows with a block of ``k + extra`` directions and back, as sums per slot, and the driver orthogonalises that block. It holds slots x block numbers
and never a matrix of slots squared; with no more slots than block, one pass is exact. Total inertia is the sum of the slots' variances, from one aggregate.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnet.lookups import with_strategy
from carnet.operators.ranking import with_global_rank
from carnet.operators.stats import standard_scale
from carnet.session import cut_lineage

# Workers get the helpers with the task, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXTRA, PASSES, CLOSE = 8, 40, 1e-10


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and row numbers of a batch."""
    slots = batch.column("slots")
    return slots.flatten().to_numpy().astype(np.int64), batch.column("values").flatten().to_numpy().astype(np.float64), np.repeat(np.arange(len(slots)), slots.value_lengths().to_numpy())


def _times(slots: np.ndarray, values: np.ndarray, owner: np.ndarray, rows: int, block: np.ndarray) -> np.ndarray:
    """Rows of a batch times a block of directions."""
    return np.stack([np.bincount(owner, values * block[slots, j], minlength=rows) for j in range(block.shape[1])], axis=1)


def _back(block: np.ndarray, means: np.ndarray):
    """Task: sums per slot of the centred rows' products with the block, times the row again; centring of the left side happens on the driver."""
    width, offset = block.shape[1], means @ block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(means), width))
        met = np.zeros(len(means), bool)
        for batch in batches:
            if batch.num_rows:
                slots, values, owner = _sparse(batch)
                product = _times(slots, values, owner, batch.num_rows, block) - offset
                for j in range(width):
                    total[:, j] += np.bincount(slots, values * product[owner, j], minlength=len(means))
                met[slots] = True
        found = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *(pa.array(total[found, j]) for j in range(width))], ["slot", *(f"y{j}" for j in range(width))])

    return run


def axes(rows: DataFrame, slots: int, k: int, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, leading variances, directions (slot, axis) and total variance of stored rows (slots, values)."""
    n = rows.count()
    cells = rows.select(F.explode(F.arrays_zip("slots", "values")).alias("c")).groupBy("c.slots").agg(F.sum("c.values").alias("s"), F.sum(F.col("c.values") * F.col("c.values")).alias("q")).toArrow()
    sums, squares = np.zeros(slots), np.zeros(slots)
    sums[cells["slots"].to_numpy()], squares[cells["slots"].to_numpy()] = cells["s"].to_numpy(), cells["q"].to_numpy()
    means, free = sums / max(n, 1), max(n - 1, 1)
    total = float(np.clip(squares - n * means * means, 0, None).sum() / free)
    width = min(slots, k + extra)
    block = np.eye(slots) if width == slots else np.linalg.qr(np.random.default_rng(3).standard_normal((slots, width)))[0]
    last = None
    for _ in range(1 if width == slots else PASSES):
        schema = "slot long, " + ", ".join(f"y{j} double" for j in range(width))
        back = rows.select("slots", "values").mapInArrow(_back(block, means), schema).groupBy("slot").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).toArrow()
        product = np.zeros((slots, width))
        at = back["slot"].to_numpy()
        for j in range(width):
            product[at, j] = back[f"y{j}"].to_numpy()
        product /= free  # the products are centred, so their sum with the means is zero
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        directions = block @ turn
        if last is not None and np.abs(values[:k] - last).max() <= CLOSE * max(values[0], 1e-300):
            break
        last = values[:k]
        if width < slots:
            block = np.linalg.qr(product @ turn)[0]
    directions = directions[:, :k]
    sign = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return means, np.clip(values[:k], 0, None), directions * np.where(sign == 0, 1, sign), total


def _fit(rows: DataFrame, names: DataFrame, slots: int, k: int, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coordinates, components, inertia) of rows (key, slots, values); ``names`` has slot and feature."""
    spark = rows.sparkSession
    rows, k = cut_lineage(rows), min(k, slots)
    if not slots:
        return spark.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, axes array<double>"), spark.createDataFrame([], "feature string, axis int, loading double"), spark.createDataFrame([], "axis int, share double, cumulative double")
    means, values, directions, total = axes(rows, slots, k)
    offset = means @ directions

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _times(*_sparse(batch), batch.num_rows, directions) - offset
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found.tolist(), pa.list_(pa.float64()))], [key, "axes"])

    coords = rows.mapInArrow(project, f"`{key}` {rows.schema[key].dataType.simpleString()}, axes array<double>")
    flat = pa.table({"slot": np.repeat(np.arange(slots), k), "axis": np.tile(np.arange(1, k + 1, dtype=np.int32), slots), "loading": directions.ravel()})
    components = spark.createDataFrame(flat).join(names, "slot").select("feature", "axis", "loading")
    shares = (values / total if total > 0 else np.zeros(k)).tolist()
    inertia = spark.createDataFrame([(j + 1, shares[j], sum(shares[:j + 1])) for j in range(k)], "axis int, share double, cumulative double")
    return coords, components, inertia


def principal_components(df: DataFrame, key: str, names: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Principal components of the vectors in ``features``; no column is scaled."""
    rows = df.select(key, F.array(*[F.lit(i) for i in range(len(names))]).alias("slots"), vector_to_array("features").alias("values"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "slot long, feature string")
    return _fit(rows, listed, len(names), k, key)


def correlation_circle(components: DataFrame, axis_a: int, axis_b: int, top: int = 5) -> DataFrame:
    """Loadings on two axes and their norm; the ``top`` variables by norm."""
    side = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("loading")))
    wide = components.groupBy("feature").agg(side(axis_a).alias("axis_a"), side(axis_b).alias("axis_b"))
    return wide.withColumn("norm", F.sqrt(F.pow("axis_a", F.lit(2)) + F.pow("axis_b", F.lit(2)))).orderBy(F.desc("norm"), "feature").limit(top)


def category_slots(df: DataFrame, columns: list[str]) -> DataFrame:
    """The dictionary of categories (c, v, n, slot): every value of every column with its rows, numbered in order of column and value."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    found = df.select(F.explode(cells).alias("x")).groupBy("x.c", "x.v").agg(F.count("*").alias("n")).where(F.col("v").isNotNull())
    return cut_lineage(with_global_rank(found, [F.col("c"), F.col("v")]).select("c", "v", "n", (F.col("rank") - 1).alias("slot")))


def _with_categories(df: DataFrame, columns: list[str], levels: DataFrame, scale) -> DataFrame:
    """The rows with a struct (slot, value) per categorical column, null where the row has no category."""
    for i, c in enumerate(columns):
        mine = levels.where(F.col("c") == c).select(F.col("v").alias(f"__v{i}"), F.struct("slot", scale(F.col("n")).alias("value")).alias(f"__c{i}"))
        df = df.join(with_strategy(mine), F.col(c).cast("string") == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    return df


def _cells(pairs: list) -> list:
    """Columns ``slots`` and ``values`` of a list of structs."""
    met = F.filter(F.array(*pairs), lambda p: p.isNotNull())
    return [F.transform(met, lambda p: p["slot"]).alias("slots"), F.transform(met, lambda p: p["value"]).alias("values")]


def multiple_correspondence(df: DataFrame, key: str, columns: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indicators divided by the square root of their margins, then principal components."""
    n, levels = df.count(), category_slots(df, columns)
    scaled = _with_categories(df, columns, levels, lambda rows: 1.0 / F.sqrt(rows * len(columns) / n) / float(np.sqrt(len(columns))))
    rows = scaled.select(key, *_cells([F.col(f"__c{i}") for i in range(len(columns))]))
    return _fit(rows, levels.select("slot", F.concat("c", F.lit("="), "v").alias("feature")), levels.count(), k, key)


def mixed_data(df: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standardised numbers next to indicators scaled by the square root of their share, then principal components."""
    n, levels = df.count(), category_slots(df, categorical)
    slots = levels.count()
    scaled = _with_categories(standard_scale(df, numeric), categorical, levels, lambda rows: 1.0 / F.sqrt(rows / n))
    numbers = [F.when(F.col(c).isNotNull(), F.struct(F.lit(slots + i).cast("long").alias("slot"), F.col(c).cast("double").alias("value"))) for i, c in enumerate(numeric)]
    rows = scaled.select(key, *_cells([*numbers, *[F.col(f"__c{i}") for i in range(len(categorical))]]))
    listed = df.sparkSession.createDataFrame([(slots + i, c) for i, c in enumerate(numeric)], "slot long, feature string")
    names = reduce(DataFrame.unionByName, [listed, levels.select("slot", F.concat("c", F.lit("="), "v").alias("feature"))])
    return _fit(rows, names, slots + len(numeric), k, key)


def contributions(components: DataFrame) -> DataFrame:
    """Share of each feature in each axis: squared loading."""
    return components.select("feature", "axis", (F.col("loading") * F.col("loading")).alias("contribution"))
