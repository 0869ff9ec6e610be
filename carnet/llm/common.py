"""Shared helpers of the training-data operators: input columns, fresh names, numbers of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the scale folder; the scan prunes what the operator does not select."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; rows without a key are in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0).cast("long"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def bounded(stored: DataFrame, max_rows: int = 50_000, max_bytes: int = 16 << 20) -> DataFrame:
    """A stored dimension with a broadcast hint if its measured rows and bytes are within the bounds; beyond, Spark chooses the join."""
    size = F.sum(F.length(F.to_json(F.struct("*"))))
    n, total = stored.limit(max_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(stored) if n <= max_rows and (total or 0) <= max_bytes else stored
