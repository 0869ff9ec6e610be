"""Dictionaries as lookup sides, chosen by their measured size.

* up to ``LITERAL_ROWS`` entries: may be part of the plan itself;
* up to ``LOOKUP_ROWS`` entries and ``LOOKUP_BYTES`` of text: broadcast;
* beyond: a join that adaptive execution chooses, and whose hot keys it splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnet.session import cut_lineage

LITERAL_ROWS = 2_000
LOOKUP_ROWS = 200_000
LOOKUP_BYTES = 32 << 20


def may_broadcast(written: DataFrame, max_rows: int = LOOKUP_ROWS) -> bool:
    """Whether the measured rows and bytes of a stored dimension allow a broadcast."""
    size = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in written.columns]))))
    n, total = written.limit(max_rows + 1).agg(F.count("*"), size).first()
    return n <= max_rows and (total or 0) <= LOOKUP_BYTES


def with_strategy(written: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """A stored dimension with a broadcast hint if :func:`may_broadcast`; beyond, Spark chooses the join at run time."""
    return F.broadcast(written) if may_broadcast(written, max_rows) else written


def as_lookup(dim: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """The dimension, written once, with the join strategy its row count allows."""
    return with_strategy(cut_lineage(dim), max_rows)


def one_value(dictionary: DataFrame) -> DataFrame:
    """One entry per key: entries with a NULL key or value say nothing, and of several values the smallest counts."""
    whole = dictionary.where(F.col("key").isNotNull() & F.col("value").isNotNull())
    return whole.groupBy("key").agg(F.min("value").alias("value"))


def small_entries(written: DataFrame, max_rows: int = LITERAL_ROWS) -> dict[str, str] | None:
    """Entries of a stored dictionary small enough to stand in the plan, else None. At most ``max_rows + 1`` rows are fetched."""
    rows = written.select("key", "value").limit(max_rows + 1).collect()
    return {r["key"]: r["value"] for r in rows} if len(rows) <= max_rows else None


def sql_list(values) -> str:
    """Values as a SQL list for ``IN``, which becomes a hash-set test."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
