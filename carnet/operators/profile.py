"""Missing-data profiles of a sheet. Column statistics are one aggregate; grids are one more."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.operators.records import column_counts, row_to_long


def percent_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, percent_missing) for the listed columns, most missing first."""
    shares = df.agg(*[F.round(100.0 * F.avg(F.col(f"`{c}`").isNull().cast("int")), 6).alias(c) for c in columns])
    return row_to_long(shares, "column_name", "percent_missing").orderBy(F.desc("percent_missing"), "column_name")


def column_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Percent missing per column on the driver: one row of as many numbers as there are columns."""
    counts = df.select(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first().asDict()
    total = counts.pop("__rows")
    return {c: 100.0 * (total - n) / total if total else 0.0 for c, n in counts.items()}


def n_missing(columns: list[str]) -> Column:
    return reduce(add, [F.col(f"`{c}`").isNull().cast("int") for c in columns], F.lit(0))


def missing_by_row(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    missing = n_missing(columns)
    return df.select(key, missing.alias("n_missing"), F.round(100.0 * missing / len(columns), 6).alias("percent_missing"))


def keep_complete_rows(df: DataFrame, columns: list[str], max_percent: float = 20.0) -> DataFrame:
    return df.where(100.0 * n_missing(columns) / len(columns) <= max_percent)


def keep_complete_columns(df: DataFrame, columns: list[str], threshold: float = 90.0) -> DataFrame:
    """Drop listed columns at or above ``threshold`` percent missing."""
    shares = column_shares(df, columns)
    return df.drop(*[c for c, share in shares.items() if share >= threshold])


def cutoff_grid(df: DataFrame, columns: list[str], column_cutoffs: list[float | None], row_cutoffs: list[float]) -> DataFrame:
    """Rows and columns left for every pair of cut-offs (None keeps all columns): conditional counts in one aggregate."""
    shares = column_shares(df, columns)
    kept = {cut: [c for c in columns if cut is None or shares[c] < cut] for cut in column_cutoffs}
    missing = df.select(*[(100.0 * n_missing(cols) / max(len(cols), 1)).alias(f"m{i}") for i, cols in enumerate(kept.values())])
    counts = [F.count(F.when(F.col(f"m{i}") <= row, 1)).alias(f"{i}|{row}") for i in range(len(kept)) for row in row_cutoffs]
    long = row_to_long(missing.agg(*counts), "cell", "n_rows")
    cell = F.split("cell", r"\|")
    names = F.create_map(*[F.lit(x) for i, cut in enumerate(kept) for x in (str(i), "none" if cut is None else f"{cut:g}")])
    sizes = F.create_map(*[x for i, cols in enumerate(kept.values()) for x in (F.lit(str(i)), F.lit(len(cols)))])
    at = F.get(cell, F.lit(0))
    return long.select(F.element_at(names, at).alias("column_cutoff"), F.get(cell, F.lit(1)).cast("double").alias("row_cutoff"),
                       F.element_at(sizes, at).alias("n_features"), "n_rows")


def missing_steps(df: DataFrame, key: str, columns: list[str], steps: list[float]) -> DataFrame:
    """For each step: columns left and each row's missing cells among the columns left that have gaps."""
    shares = column_shares(df, columns)
    clean = [c for c in columns if shares[c] == 0]
    rows = []
    for step in steps:
        gaps = [c for c in columns if 0 < shares[c] < step]
        missing = n_missing(gaps)
        rows.append(F.struct(F.lit(float(step)).alias("step"), F.lit(len(gaps) + len(clean)).alias("n_columns"), missing.alias("n_missing"),
                             F.round(100.0 * missing / len(columns), 6).alias("percent_missing")))
    return df.select(key, F.explode(F.array(*rows)).alias("s")).select(key, "s.*")


def coverage(df: DataFrame, columns: list[str], at_least: int = 75) -> DataFrame:
    long = row_to_long(df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]), "column_name", "n_known")
    return long.withColumn("enough", F.col("n_known") >= at_least)


def complete_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Total, known, and complete-row cells of the sheet."""
    missing = n_missing(columns)
    return df.agg((F.count("*") * len(columns)).alias("total_cells"), F.sum(F.lit(len(columns)) - missing).alias("known_cells"),
                  (F.count(F.when(missing == 0, 1)) * len(columns)).alias("complete_row_cells"))


def group_histogram(df: DataFrame, group: str, value: str, bins: int = 10) -> DataFrame:
    """Range and histogram of a variable in each group, over bins common to all groups."""
    limits = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("l")).scalar()
    width = (limits["hi"] - limits["lo"]) / bins
    bin_no = F.least(F.lit(bins - 1), F.floor((F.col(value) - limits["lo"]) / width)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(group, bin_no.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def known_columns(df: DataFrame) -> list[str]:
    counts = column_counts(df)
    return [c for c in df.columns if counts[c] > 0]
