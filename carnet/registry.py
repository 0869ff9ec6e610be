"""Named queries: one Spark callable per operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory name; ``sql`` is the DuckDB equivalent when SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Text tables: heavy work per row, so a table stored in few splits is spread over the cores by its key.
TEXT_KEYS = {"documents": ("doc_id",), "conversations": ("conv_id", "turn"), "pages": ("page_id",)}


# Stored bytes of one part when a table is spread.
SPREAD_BYTES = 4 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files a frame reads, on any file system Spark can reach."""
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in df.inputFiles())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed over all cores when the scan gives fewer than two splits per core; otherwise the frame as it is. Parts beyond one per core keep
    to ``SPREAD_BYTES`` of files, so that a task's share does not grow with the table.
    Large tables have far more splits than cores, so they are never shuffled here. Hashing by key, not round robin,
    keeps retried tasks deterministic and serves later grouping by the same key."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(max(cores, -(-stored_bytes(df) // SPREAD_BYTES)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the given scale folder; columns and filters are pruned by the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, *TEXT_KEYS[name]) if name in TEXT_KEYS else df
