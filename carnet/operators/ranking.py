"""Exact ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet.session import cut_lineage


def with_global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Exact 1-based position in a total order. Rows are range-partitioned and written once; only the per-partition
    row counts (one row per partition) are accumulated in one place. ``order`` must end in a unique column."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("__pid", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    sizes = placed.groupBy("__pid").agg(F.count("*").alias("__n"), F.min("__seq").alias("__base"))
    running = F.sum("__n").over(W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__pid", "__base", F.coalesce(running, F.lit(0)).alias("__offset"))
    ranked = placed.join(F.broadcast(offsets), "__pid")
    return ranked.withColumn(name, F.col("__offset") + F.col("__seq") - F.col("__base") + 1).drop("__pid", "__seq", "__base", "__offset")


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Exact running sums (``{new: source}``) along a total order: local sums inside range partitions, plus one offset row
    per partition. ``order`` must end in a unique column."""
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()))
    totals = placed.groupBy("__pid").agg(*[F.sum(src).alias(f"__t_{new}") for new, src in sums.items()])
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__pid", *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}") for new in sums])
    upto = W.partitionBy("__pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumns({new: F.sum(src).over(upto) for new, src in sums.items()}).join(F.broadcast(offsets), "__pid")
    return local.withColumns({new: F.col(new) + F.col(f"__o_{new}") for new in sums}).drop("__pid", *[f"__o_{new}" for new in sums])


def rank_in_buckets(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Exact rank of each row inside its group and the group size (``group_size``). ``bucket`` must be monotone in
    ``order`` and bounds how much one window sees: a group of any size is ranked bucket by bucket, then offset.
    Keys are compared as one struct, so rows with a NULL group or bucket keep their place."""
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    placed = df.withColumn("__g", group).withColumn("__k", F.struct(F.col("__g").alias("g"), bucket.alias("b")))
    sizes = placed.groupBy("__k").agg(F.count("*").alias("__n"))
    before = W.partitionBy("__k.g").orderBy("__k.b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__k", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.sum("__n").over(W.partitionBy("__k.g")).alias("group_size"))
    local = F.row_number().over(W.partitionBy("__k").orderBy(*order))
    ranked = placed.withColumn("__local", local).join(offsets, "__k")
    return ranked.withColumn(name, F.col("__offset") + F.col("__local")).drop("__g", "__k", "__local", "__offset")


def rank_in_hash_order(df: DataFrame, groups: list[str], key: str, name: str = "rank", digits: int = 3) -> DataFrame:
    """Rank of each row of a group in md5 order of ``key``: a shuffle that is the same on every run and engine.
    Hash prefixes cut every group in 16**digits even buckets."""
    hashed = df.withColumn("__md5", F.md5(F.col(key).cast("string")))
    return rank_in_buckets(hashed, groups, F.substring("__md5", 1, digits), [F.col("__md5"), F.col(key)], name).drop("__md5")


def top_per_group(df: DataFrame, groups: list[str], by: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; for ``n`` up to a thousand Spark keeps at most ``n`` rows per group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*by))).where(F.col("rank") <= n)
