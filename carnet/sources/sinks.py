"""Writers: suggestion families, patient exports, prediction runs."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_suggestions(suggestions: DataFrame, path: str) -> None:
    """One folder per family; rows are spread by hash inside a family, so no family goes through one task."""
    suggestions.write.mode("overwrite").partitionBy("category").parquet(path)


def export_rows(patients: DataFrame, corrections: DataFrame, comparison: DataFrame, exported_at: str) -> DataFrame:
    """Export document of each patient: corrected text, else source text, else empty."""
    saved = corrections.select("patient_id", F.col("text_after").alias("__a"))
    source = comparison.select("patient_id", F.col("text").alias("__b"))
    rows = patients.select("patient_id").join(saved, "patient_id", "left").join(source, "patient_id", "left")
    after = F.when(F.trim(F.col("__a")) != "", F.col("__a")).otherwise(F.coalesce("__b", F.lit("")))
    return rows.select(F.lit("1.0").alias("schema_version"), F.lit(exported_at).alias("exported_at"), "patient_id", after.alias("text_after"))


def write_export(rows: DataFrame, path: str) -> None:
    """JSON lines, one document per patient."""
    rows.write.mode("overwrite").json(path)


def run_metadata(spark, rows: int, **settings) -> DataFrame:
    """One-row metadata record of a prediction run."""
    record = {"timestamp": datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S"), "input_rows": rows, **settings}
    return spark.createDataFrame([(json.dumps(record, ensure_ascii=False, sort_keys=True),)], "meta string")


def write_run(predictions: DataFrame, path: str, **settings) -> DataFrame:
    """Write predictions and their metadata side by side; the row count is taken from the written files."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    spark = predictions.sparkSession
    meta = run_metadata(spark, spark.read.parquet(f"{path}/predictions").count(), path=path, **settings)
    meta.write.mode("overwrite").json(f"{path}/meta")
    return meta
