"""Session helpers: a default session, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "carnet", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the library expects; cluster settings win over none of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``; a private one only if unset in local mode, where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="carnet-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written intermediate table in the shared folder."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def work_root(spark: SparkSession) -> str:
    """The application's own folder for written tables."""
    return f"{shared_dir(spark).rstrip('/')}/carnet/{spark.sparkContext.applicationId}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, on any file system Spark can reach."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_work(spark: SparkSession) -> None:
    """Delete all tables the application wrote with :func:`work_path`; call it when their results have been read."""
    drop_path(spark, work_root(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise with a reliable checkpoint: the result no longer depends on shuffle files of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
