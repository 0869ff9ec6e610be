"""Repair and typing of wide, messy records. Wide sheets are made long once, so per-column work is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from carnet import constants as K
from carnet.operators.ranking import with_global_rank


def to_long(df: DataFrame, keys: list[str], columns: list[str] | None = None, name: str = "column_name", value: str = "value") -> DataFrame:
    """One row per cell, cells as text."""
    listed = columns or [c for c in df.columns if c not in keys]
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in listed])
    return df.select(*keys, F.explode(cells).alias("__c")).select(*keys, F.col("__c.c").alias(name), F.col("__c.v").alias(value))


def row_to_long(row: DataFrame, name: str, value: str) -> DataFrame:
    """One-row aggregate turned to (column, value) rows."""
    return row.unpivot([], [f"`{c}`" for c in row.columns], name, value)


def column_counts(df: DataFrame) -> dict[str, int]:
    """Non-null cells of every column: one aggregate, one row back."""
    return df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()


def drop_columns_and_empty(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop named columns, then all-null columns and all-null rows."""
    kept = df.drop(*names)
    counts = column_counts(kept)
    return kept.select(*[f"`{c}`" for c in kept.columns if counts[c] > 0]).dropna(how="all")


def two_level(df: DataFrame, keys: list[str], prefix: str, sep: str = ">") -> DataFrame:
    """Long form of 'prefix Section>Field' columns as (nature, acte, value)."""
    long = to_long(df, keys)
    bare = F.when(F.col("column_name").startswith(prefix), F.substring("column_name", F.lit(len(prefix) + 1), F.length("column_name"))).otherwise(F.col("column_name"))
    parts = F.split(bare, sep)
    return long.select(*keys, F.trim(F.get(parts, F.lit(0))).alias("nature"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("acte"), "value")


def na_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*K.NA_TOKENS), F.col(c)) for c in columns})


ISO_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
US_TIME = r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2}:\d{2})$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
FRENCH_DATE = r"^(\d{2})/(\d{2})/(\d{4})$"


def parse_timestamp(c: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' or 'MM/dd/yyyy HH:mm:ss' without a time zone; NULL when it is not a date."""
    return F.when(c.rlike(ISO_TIME), c.try_cast("timestamp_ntz")).when(c.rlike(US_TIME), F.regexp_replace(c, US_TIME, "$3-$1-$2 $4").try_cast("timestamp_ntz"))


def parse_date(c: Column) -> Column:
    """'yyyy-MM-dd' or 'dd/MM/yyyy' as a timestamp at midnight."""
    return F.when(c.rlike(ISO_DATE), c.try_cast("timestamp_ntz")).when(c.rlike(FRENCH_DATE), F.regexp_replace(c, FRENCH_DATE, "$3-$2-$1").try_cast("timestamp_ntz"))


def retype(c: Column) -> Column:
    """Typed value of a text cell as a struct with at most one field set; all are NULL for missing cells."""
    low = F.lower(c)
    as_long = F.when(c.rlike(r"^\d+$"), c.try_cast("bigint"))
    as_ts = parse_timestamp(c)
    as_bool = F.when(low.isin(*K.TRUE_WORDS), True).when(low.isin(*K.FALSE_WORDS), False)
    missing = low.isin(*K.NONE_WORDS)
    as_text = F.when(~missing & as_long.isNull() & as_ts.isNull() & as_bool.isNull(), c)
    return F.struct(as_long.alias("v_long"), as_ts.alias("v_ts"), as_bool.alias("v_bool"), as_text.alias("v_str"))


def retype_cells(long: DataFrame, value: str = "value", name: str = "column_name") -> DataFrame:
    """Typed cells of a long sheet; in columns named '...Date...' a bare date is a timestamp too."""
    typed = long.withColumn("__t", retype(F.col(value)))
    bare_date = F.when(F.col(name).contains("Date"), parse_date(F.col(value)))
    ts = F.coalesce("__t.v_ts", bare_date)
    text = F.when(ts.isNull(), F.col("__t.v_str"))
    return typed.select(*[c for c in long.columns if c != value], F.col("__t.v_long").alias("v_long"), ts.alias("v_ts"), F.col("__t.v_bool").alias("v_bool"), text.alias("v_str"))


def as_bool(c: Column) -> Column:
    """Yes / no spellings to a boolean; NULL for anything else."""
    low = F.lower(c)
    return F.when(low.isin(*K.TRUE_WORDS), True).when(low.isin(*K.FALSE_WORDS), False)


def bool_cells(df: DataFrame) -> DataFrame:
    """(column_name, n_bool): yes / no cells per text column, in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, TY.StringType)]
    return row_to_long(df.agg(*[F.count(as_bool(F.col(f"`{c}`"))).alias(c) for c in names]), "column_name", "n_bool")


def boolean_columns(df: DataFrame) -> list[str]:
    return sorted(r["column_name"] for r in bool_cells(df).where(F.col("n_bool") > 0).collect())


def split_boolean(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Typed boolean columns apart from the rest of the sheet, both with the row keys."""
    found = boolean_columns(df.drop(*keys))
    typed = df.select(*keys, *[as_bool(F.col(f"`{c}`")).alias(c) for c in found])
    return typed, df.drop(*found)


def diagnosis_flag(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("vrai", "oui", "true", "1"), "VRAI").when(low.isin("faux", "non", "false", "0"), "FAUX").otherwise(F.trim(c))


# Date layouts recognised by the parse test.
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss")
FLOAT_PATTERN = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


def is_date_like(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(layout)) for layout in DATE_LAYOUTS]).isNotNull()


def is_float_like(c: Column) -> Column:
    return c.rlike(FLOAT_PATTERN)


def binarize(columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return F.least(F.lit(1), total)


def multiclass_shift(c: Column) -> Column:
    """0 missing stands apart: NULL to 2, other classes one up."""
    return F.when(c.isNull(), F.lit(2)).otherwise(c + 1)


def missing_to_zero(c: Column) -> Column:
    return F.when(c == 2, F.lit(0)).otherwise(c)


def label_name(c: Column, other: str = "missing") -> Column:
    return F.when(c == 0, "absent").when(c == 1, "present").otherwise(other)


def fill_missing_class(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(2)) for c in columns})


def dropna_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows before, rows kept, and percent lost when rows with any NULL go."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    counts = df.agg(F.count("*").alias("n_rows"), F.count(F.when(full, 1)).alias("n_kept"))
    return counts.withColumn("percent_lost", F.round(100.0 * (F.col("n_rows") - F.col("n_kept")) / F.col("n_rows"), 6))


def information_present(c: Column) -> Column:
    return c.isNotNull().cast("int")


def find_malformed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cells in which several records were swallowed: they hold a line break and an empty field."""
    long = to_long(df, keys)
    return long.where(F.col("value").contains("\n") & F.col("value").contains(";;"))


def repair_malformed(df: DataFrame, columns: list[str], sep: str = ";") -> DataFrame:
    """Split swallowed cells into records of the sheet's width and add them as rows.

    In a malformed row the first line of the swallowed cell is that cell's own value; every further line is a record
    of its own. Records are cut or padded to the width of the sheet and the export mark ``_x000D_`` is removed.
    """
    clean = lambda c: F.replace(c, F.lit("_x000D_"), F.lit(""))
    bad = lambda c: c.contains("\n") & c.contains(";;")
    own = [F.when(bad(F.col(c)), F.get(F.split(clean(F.col(c)), "\n"), F.lit(0))).otherwise(F.col(c)).alias(c) for c in columns]
    none = F.array().cast("array<string>")
    swallowed = F.concat(*[F.when(bad(F.col(c)), F.slice(F.split(clean(F.col(c)), "\n"), F.lit(2), F.size(F.split(clean(F.col(c)), "\n")))).otherwise(none) for c in columns])
    lines = df.select(F.explode(swallowed).alias("line")).where(F.trim("line") != "")
    fields = F.split("line", sep)
    records = lines.select(*[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return df.select(*own).unionByName(records)


SEPARATOR = " | "


def cell_values(c: Column, sep: str = SEPARATOR) -> Column:
    return F.split(c, "\\Q" + sep + "\\E")


def multi_value_count(columns: list[str], sep: str = SEPARATOR) -> Column:
    """Largest number of values in a cell of the row."""
    sizes = [F.coalesce(F.size(cell_values(F.col(c), sep)), F.lit(1)) for c in columns]
    return F.greatest(*sizes) if len(sizes) > 1 else sizes[0]


def explode_multi(df: DataFrame, keys: list[str], columns: list[str], sep: str = SEPARATOR) -> DataFrame:
    """Parallel multi-value cells to rows by position; shorter lists are padded with NULL, row keys repeat."""
    zipped = F.arrays_zip(*[F.coalesce(cell_values(F.col(c), sep), F.array(F.lit(None).cast("string"))).alias(c) for c in columns])
    return df.select(*keys, F.posexplode_outer(zipped).alias("pos", "__z")).select(*keys, "pos", *[F.col(f"__z.{c}").alias(c) for c in columns])


def separator_columns(df: DataFrame, sep: str = "|") -> DataFrame:
    """Which text columns hold the separator, in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, TY.StringType)]
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`").contains(sep)), F.lit(False)).alias(c) for c in names])
    return row_to_long(flags, "column_name", "has_separator")


def map_ids(df: DataFrame, id_column: str, mapping: DataFrame) -> DataFrame:
    """Source ids replaced by study ids (source_id, study_id); ids without an entry stay as they are."""
    joined = df.join(mapping.select(F.col("source_id").alias("__s"), "study_id"), F.col(id_column) == F.col("__s"), "left")
    return joined.withColumn(id_column, F.coalesce("study_id", F.col(id_column))).drop("__s", "study_id")


def unused_ids(mapping: DataFrame, df: DataFrame, id_column: str) -> DataFrame:
    """Mapped ids without any record."""
    seen = df.select(F.col(id_column).alias("source_id")).distinct()
    return mapping.join(seen, "source_id", "left_anti")


def slice_rows(df: DataFrame, order: list[Column], after: int, upto: int) -> DataFrame:
    """Remove the rows at positions ``after`` < position <= ``upto`` of the given total order."""
    ranked = with_global_rank(df, order, "__rank")
    return ranked.where((F.col("__rank") <= after) | (F.col("__rank") > upto)).drop("__rank")
