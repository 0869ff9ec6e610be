"""Univariate statistics against an outcome. Sufficient statistics are aggregated once for all features;
p-values are computed on the few aggregated rows."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from carnet import constants as K
from carnet.operators.ranking import with_global_rank

# Workers get the p-value helpers with the task, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Columns of a block of the cross-products, and cells that one task of the merge adds up (6 x 64 x 64 doubles each).
BLOCK, FAN = 64, 128
_SUMS = ("n", "x", "y", "xx", "yy", "xy")
CELLS = "left int, right int, part int, " + ", ".join(f"{n} array<double>" for n in _SUMS)


def _cells(left: list[int], right: list[int], part: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``CELLS``; each of ``sums`` is an array (sum, column, column)."""
    columns = [pa.array([m[k].ravel() for m in sums], pa.list_(pa.float64())) for k in range(len(_SUMS))]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in (left, right, part)), *columns], ["left", "right", "part", *_SUMS])


def _block_products(anchors: list[float]):
    """Task: per pair of column blocks the sums of 1, x, y, x squared, y squared and xy over the rows where both columns have a value, as matrix products of
    a batch. Values are taken from their column's anchor, so a large mean costs no digits."""
    width, centre = len(anchors), np.array(anchors)
    blocks = [slice(at, min(at + BLOCK, width)) for at in range(0, width, BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            finite = np.isfinite(values)
            x, here = np.where(finite, values - centre, 0.0), finite.astype(np.float64)
            square = x * x
            for i, a in enumerate(blocks):
                for j, b in enumerate(blocks[i:], i):
                    found = np.stack([u[:, a].T @ v[:, b] for u, v in ((here, here), (x, here), (here, x), (square, here), (here, square), (x, x))])
                    total[i, j] = total[i, j] + found if (i, j) in total else found
        if total:
            part = TaskContext.get().partitionId() % FAN
            for (i, j), sums in total.items():
                yield _cells([i], [j], [part], [sums])

    return run


def _merge_cells(key, table):
    """One cell of a group of cells."""
    merged = np.stack([np.add.reduce([c.values.to_numpy() for c in table.column(n).combine_chunks()]) for n in _SUMS])
    return pa.Table.from_batches([_cells([key[0].as_py()], [key[1].as_py()], [0], [merged])])


def _correlate(columns: list[str]):
    """Correlations of the pairs of a merged cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, second = row["left"] * BLOCK, row["right"] * BLOCK
                size = min(BLOCK, len(columns) - second)
                n, x, y, xx, yy, xy = (np.array(row[k]).reshape(-1, size) for k in _SUMS)
                spread = np.clip(n * xx - x * x, 0, None) * np.clip(n * yy - y * y, 0, None)
                # What is left of equal values after rounding is no variance.
                varies = (n > 1) & (n * xx - x * x > 1e-12 * n * xx) & (n * yy - y * y > 1e-12 * n * yy)
                r = np.clip((n * xy - x * y) / np.sqrt(np.where(varies, spread, 1.0)), -1, 1)
                a, b = np.nonzero(np.arange(len(n))[:, None] + first < np.arange(size)[None, :] + second)
                yield pa.RecordBatch.from_arrays([pa.array([columns[first + i] for i in a], pa.string()), pa.array([columns[second + i] for i in b], pa.string()), pa.array(r[a, b], mask=~varies[a, b])],
                                                 ["feature_a", "feature_b", "correlation"])

    return run


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns on their common values, in one scan of the table however many columns it has. Each task adds up the
    cross-products of column blocks, one cell per pair of blocks, and cells are merged in two steps by pair of blocks. NaN and infinite values count
    as missing; pairs whose common rows do not vary are NULL."""
    numbers = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, correlation double")
    usual = df.select(*numbers).limit(256).agg(*[F.avg(F.when(F.abs(f"c{i}") < float("inf"), F.col(f"c{i}"))).alias(f"c{i}") for i in range(len(columns))]).first()
    anchors = [0.0 if v is None or not math.isfinite(v) else v for v in usual]
    # A task's cells do not depend on its rows, so few tasks with many rows each send least.
    wide = df.select(F.array(*numbers).alias("values")).coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    cells = wide.mapInArrow(_block_products(anchors), CELLS)
    cells = cells.groupBy("left", "right", "part").applyInArrow(_merge_cells, CELLS).groupBy("left", "right").applyInArrow(_merge_cells, CELLS)
    pairs = cells.mapInArrow(_correlate(list(columns)), "feature_a string, feature_b string, correlation double")
    return pairs.withColumn("correlation", F.round("correlation", 6)).orderBy(F.desc("correlation"), "feature_a", "feature_b")


def _per_feature(df: DataFrame, features: list[str], outcome: str, stats) -> DataFrame:
    """Aggregate the same statistics for each feature and outcome class in one pass, as (feature, class, ...) rows."""
    grouped = df.where(F.col(outcome).isNotNull()).groupBy(F.col(outcome).alias("cls")).agg(
        *[F.struct(F.lit(f).alias("feature"), *stats(F.col(f))).alias(f"s{i}") for i, f in enumerate(features)])
    names = [c for c in grouped.columns if c != "cls"]
    return grouped.select("cls", F.explode(F.array(*names)).alias("s")).select("cls", "s.*")


def _moments(c: Column):
    x = c.cast("double")
    return F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.sum(x).alias("total")


def t_statistics(df: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """Student t of each numeric feature between outcome 1 and 0 (equal variances), with degrees of freedom."""
    moments = _per_feature(df, features, outcome, _moments)
    side = lambda v, c: F.max(F.when(F.col("cls") == v, F.col(c)))
    wide = moments.groupBy("feature").agg(*[side(v, c).alias(f"{c}{v}") for v in (0, 1) for c in ("n", "mean", "var")])
    dof = F.col("n0") + F.col("n1") - 2
    pooled = ((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / dof
    t = (F.col("mean1") - F.col("mean0")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    return wide.select("feature", "n0", "n1", F.round(t, 6).alias("t"), dof.alias("dof"))


def contingency(df: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """(feature, value, cls, n) counts of categorical features against the outcome, counted map-side first."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    long = df.where(F.col(outcome).isNotNull()).select(F.col(outcome).alias("cls"), F.explode(cells).alias("c")).select("cls", "c.*")
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value", "cls").agg(F.count("*").alias("n"))


def chi2_statistics(df: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """Contingency chi-square of each categorical feature, with the continuity correction for 2 x 2 tables.
    Empty cells need no rows: the sum of o^2 / e over filled cells less n is the statistic."""
    cells = contingency(df, features, outcome)
    rows = cells.groupBy("feature", "value").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("feature", "cls").agg(F.sum("n").alias("c"))
    totals = cells.groupBy("feature").agg(F.sum("n").alias("total"), F.countDistinct("value").alias("n_values"), F.countDistinct("cls").alias("n_classes"))
    joined = cells.join(rows, ["feature", "value"]).join(cols, ["feature", "cls"]).join(totals, "feature")
    e = F.col("r") * F.col("c") / F.col("total")
    parts = joined.groupBy("feature", "total", "n_values", "n_classes").agg(F.sum(F.col("n") * F.col("n") / e).alias("s"), F.max(F.abs(F.col("n") - e)).alias("gap"))
    inverse_rows = rows.groupBy("feature").agg(F.sum(1 / F.col("r")).alias("ir"))
    inverse_cols = cols.groupBy("feature").agg(F.sum(1 / F.col("c")).alias("ic"))
    full = parts.join(inverse_rows, "feature").join(inverse_cols, "feature")
    shrunk = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    yates = shrunk * shrunk * F.col("total") * F.col("ir") * F.col("ic")
    chi2 = F.when((F.col("n_values") == 2) & (F.col("n_classes") == 2), yates).otherwise(F.col("s") - F.col("total"))
    return full.select("feature", F.round(chi2, 6).alias("chi2"), ((F.col("n_values") - 1) * (F.col("n_classes") - 1)).alias("dof"))


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * scale


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(TY.DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) or k <= 0 else _gamma_q(k / 2, s / 2) for s, k in zip(stat, dof)], dtype="float64")


@F.pandas_udf(TY.DoubleType())
def t_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) else _beta_i(k / 2, 0.5, k / (k + s * s)) for s, k in zip(stat, dof)], dtype="float64")


def p_label(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").when(p < 0.01, "<0.01").otherwise(F.round(p, 3).cast("string"))


def t_tests(df: DataFrame, features: list[str], outcome: str) -> DataFrame:
    tested = t_statistics(df, features, outcome).withColumn("p", t_p(F.col("t"), F.col("dof").cast("double")))
    return tested.withColumn("p_label", p_label(F.col("p")))


def chi2_tests(df: DataFrame, features: list[str], outcome: str) -> DataFrame:
    tested = chi2_statistics(df, features, outcome).withColumn("p", chi2_p(F.col("chi2"), F.col("dof").cast("double")))
    return tested.withColumn("verdict", F.when(F.col("p") < 0.05, "significant").when(F.col("p") < 0.1, "trend").otherwise("none"))


def crosstab(df: DataFrame, value: str, outcome: str, classes: list) -> DataFrame:
    """Counts of each feature value by outcome class; classes are named so that the schema needs no extra job."""
    return df.groupBy(value).agg(*[F.count(F.when(F.col(outcome) == c, 1)).alias(f"n_{c}") for c in classes])


def _top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def select_chi2(df: DataFrame, features: list[str], outcome: str, k: int = 20) -> DataFrame:
    """Chi-square score of non-negative features on per-class sums."""
    sums = _per_feature(df, features, outcome, lambda c: (F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).alias("o"), F.count(F.lit(1)).alias("rows")))
    totals = sums.groupBy("feature").agg(F.sum("o").alias("t"), F.sum("rows").alias("all"))
    e = F.col("rows") / F.col("all") * F.col("t")
    scored = sums.join(totals, "feature").groupBy("feature").agg(F.round(F.sum((F.col("o") - e) * (F.col("o") - e) / e), 4).alias("score"))
    return _top(scored, k)


def select_f(df: DataFrame, features: list[str], outcome: str, k: int = 20) -> DataFrame:
    """ANOVA F score of each feature, from class counts, means and variances."""
    m = _per_feature(df, features, outcome, _moments)
    grand = m.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("g"))
    gap = F.col("mean") - F.col("g")
    parts = m.join(grand, "feature").groupBy("feature").agg(
        F.sum(F.col("n") * gap * gap).alias("between"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    score = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return _top(parts.select("feature", F.round(score, 4).alias("score")), k)


def binned(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Numeric columns replaced by the number of their equal-width bin (from 0); limits of all columns come from one aggregate."""
    limits = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns]).first().asDict()
    number = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - limits[c]["lo"]) / (limits[c]["hi"] - limits[c]["lo"]) * bins)).cast("int")
    return df.withColumns({c: number(c) if limits[c]["lo"] is not None and limits[c]["lo"] < limits[c]["hi"] else F.when(F.col(c).isNotNull(), 0) for c in columns})


def select_mi(df: DataFrame, features: list[str], outcome: str, k: int = 20, bins: int | None = None) -> DataFrame:
    """Mutual information (nats) of each feature with the outcome, from joint counts. With ``bins``, numeric features are first put in that
    many bins of equal width; without, every distinct value is a category."""
    kinds = dict(df.dtypes)
    numeric = [f for f in features if bins and kinds[f].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    cells = contingency(binned(df, numeric, bins) if numeric else df, features, outcome)
    rows = cells.groupBy("feature", "value").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("feature", "cls").agg(F.sum("n").alias("c"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("t"))
    joined = cells.join(rows, ["feature", "value"]).join(cols, ["feature", "cls"]).join(total, "feature")
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("c"))))
    return _top(joined.groupBy("feature").agg(F.round(mi, 6).alias("score")), k)


def order_values(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Exact k-th smallest values (1-based) of several columns at once, NULL left out, in the order -Infinity, numbers, Infinity, NaN. Each pass
    counts 1,024 even buckets of every range still open and keeps one; only bucket counts reach the driver, and all columns
    share the passes. A range always narrows, since its ends fall in different buckets."""
    x = {c: F.col(c).cast("double") for c in wanted}
    finite = {c: ~F.isnan(v) & (F.abs(v) != float("inf")) for c, v in x.items()}
    first = df.agg(*[F.struct(F.count_if(v == float("-inf")).alias("low"), F.count_if(finite[c]).alias("n"), F.count_if(v == float("inf")).alias("high"),
                              F.min(F.when(finite[c], v)).alias("lo"), F.max(F.when(finite[c], v)).alias("hi")).alias(c) for c, v in x.items()]).first().asDict()
    out, open_ = {}, {}
    for c, ks in wanted.items():
        s = first[c]
        for k in ks:
            if k <= s["low"]:
                out[c, k] = float("-inf")
            elif k <= s["low"] + s["n"]:
                open_[c, k] = (s["lo"], s["hi"], s["low"])
            else:
                out[c, k] = float("inf") if k <= s["low"] + s["n"] + s["high"] else float("nan")
    while open_:
        out |= {t: lo for t, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {t: r for t, r in open_.items() if r[0] != r[1]}
        if not open_:
            break
        cells = []
        for nth, ((c, _), (lo, hi, _)) in enumerate(open_.items()):
            half = 0.5 if math.isinf(hi - lo) else 1.0
            at = F.floor((x[c] * half - lo * half) / (hi * half - lo * half) * 1024)
            cells.append(F.when(finite[c] & x[c].between(lo, hi), F.struct(F.lit(nth).alias("t"), F.least(F.lit(1023), at).alias("b"), x[c].alias("x"))))
        counted = df.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s")).groupBy("s.t", "s.b").agg(F.count("*").alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi"))
        names, done = list(open_), set()
        for row in counted.orderBy("t", "b").collect():
            target = names[row["t"]]
            if target not in done:
                _, _, below = open_[target]
                if below + row["n"] >= target[1]:
                    open_[target] = (row["lo"], row["hi"], below)
                    done.add(target)
                else:
                    open_[target] = (*open_[target][:2], below + row["n"])
    return out


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Median of each column, None without values; the middle two are averaged."""
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    middle = {c: sorted({(n + 1) // 2, n // 2 + 1}) for c, n in sizes.items() if n}
    values = order_values(df, middle) if middle else {}
    return {c: sum(values[c, k] for k in middle[c]) / len(middle[c]) if c in middle else None for c in columns}


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_medians(df, [column])[column]


def most_frequent(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent value of each column, the smallest on ties: all columns are counted in one pass as text, numbers compare as numbers."""
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c).cast("double") if kinds[c] not in ("string", "boolean", "date", "timestamp") else F.lit(None).cast("double")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), number(c).alias("x"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    counted = df.select(F.explode(cells).alias("s")).where("s.v IS NOT NULL").groupBy("s.i", "s.x", "s.v").agg(F.count("*").alias("n"))
    best = counted.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("k"), "x", "v")).alias("b")).collect()
    return {columns[r["i"]]: r["b"]["v"] for r in best}


def impute(df: DataFrame, columns: list[str], strategy: str = "mean") -> DataFrame:
    """Missing cells replaced by the column's mean, median or most frequent value, found for all columns together."""
    if strategy == "mean":
        fills = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    elif strategy == "median":
        fills = exact_medians(df, columns)
    elif strategy == "most_frequent":
        found, kinds = most_frequent(df, columns), dict(df.dtypes)
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(found.get(c)).cast(kinds[c])) for c in columns})
    else:
        raise ValueError(strategy)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fills[c])) for c in columns})


def one_hot(df: DataFrame, column: str, zero_name: str = "aucun") -> DataFrame:
    """Dummy 0 / 1 columns named 'column_value'; a text '0' is called ``zero_name``. The category list becomes the schema, however long it is;
    for columns with very many categories :func:`one_hot_sparse` keeps one vector column instead."""
    value = F.when(F.col(column).cast("string") == "0", zero_name).otherwise(F.col(column).cast("string"))
    names = sorted(r[0] for r in df.select(value.alias("v")).where(F.col("v").isNotNull()).distinct().collect())
    return df.select(*[f"`{c}`" for c in df.columns if c != column], *[F.coalesce((value == n).cast("int"), F.lit(0)).alias(f"{column}_{n}") for n in names])


def one_hot_sparse(df: DataFrame, column: str) -> DataFrame:
    """The wide form of the same encoding: a sparse 0 / 1 vector in column 'column_onehot', one slot per category in sorted order."""
    coded = ordinal_encode(df, column)
    slots = df.select(column).where(F.col(column).isNotNull()).distinct().count()
    encoder = OneHotEncoder(inputCols=[f"{column}_code"], outputCols=[f"{column}_onehot"], dropLast=False, handleInvalid="keep")
    padded = coded.withColumn(f"{column}_code", F.coalesce(F.col(f"{column}_code"), F.lit(slots)))
    return encoder.fit(padded).transform(padded).drop(column, f"{column}_code")


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): position of each distinct value in sorted order, from 0, without a single-task sort."""
    distinct = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_global_rank(distinct, [F.col("value")], "code").withColumn("code", (F.col("code") - 1).cast("int"))


def ordinal_encode(df: DataFrame, column: str) -> DataFrame:
    codes = ordinal_codes(df, column).withColumnRenamed("value", column).withColumnRenamed("code", f"{column}_code")
    return df.join(codes, column, "left")


def encode_targets(df: DataFrame, text_columns: list[str], one_hot_text: bool) -> DataFrame:
    """One-hot the text targets, or give every text target its ordinal code."""
    for c in text_columns:
        df = one_hot(df, c) if one_hot_text else ordinal_encode(df, c).drop(c)
    return df


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; means and deviations are one aggregated row."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    moments = row.select(F.struct(*row.columns).alias("m")).scalar()
    return df.withColumns({c: (F.col(c) - moments[f"m_{c}"]) / moments[f"s_{c}"] for c in columns})


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind: text, numeric, date, boolean, other."""
    kinds: dict[str, list[str]] = {"text": [], "numeric": [], "date": [], "boolean": [], "other": []}
    for name, kind in df.dtypes:
        base = kind.split("(")[0]
        if base in ("string", "varchar", "char"):
            kinds["text"].append(name)
        elif base in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
            kinds["numeric"].append(name)
        elif base in ("date", "timestamp", "timestamp_ntz"):
            kinds["date"].append(name)
        else:
            kinds["boolean" if base == "boolean" else "other"].append(name)
    return kinds


def binary_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, is_binary): at most two distinct values. Sketch-free: at most three values per task and column are kept."""
    few = [F.struct(F.lit(c).alias("column_name"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"c{i}") for i, c in enumerate(columns)]
    limits = df.agg(*few).first().asDict()
    between = []
    for i, c in enumerate(columns):
        lo, hi = limits[f"c{i}"]["lo"], limits[f"c{i}"]["hi"]
        inside = F.lit(False) if lo is None else (F.col(c) != lo) & (F.col(c) != hi)
        between.append((~F.coalesce(F.bool_or(inside), F.lit(False))).alias(c))
    row = df.agg(*between)
    return row.unpivot([], columns, "column_name", "is_binary")


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one distinct value: smallest equals largest."""
    row = df.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if row[c]]


def at_most_one_of_pair(columns: list[str], pairs=K.CORRELATED_PAIRS) -> list[str]:
    """Columns in order, without those whose declared partner was already taken."""
    partner: dict[str, set[str]] = {}
    for a, b in pairs:
        partner.setdefault(a, set()).add(b)
        partner.setdefault(b, set()).add(a)
    kept: list[str] = []
    for c in columns:
        if not partner.get(c, set()) & set(kept):
            kept.append(c)
    return kept
