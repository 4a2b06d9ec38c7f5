"""Session defaults: adaptive execution, UTC, Arrow, skew joins; sizes are left to the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "paragraf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults, overridden by `conf` (underscores stand for dots)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it by its own path."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (known.get("PYTHONPATH"), ROOT) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for files all executors see; a folder of our own only where one machine is the cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="paragraf-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Rows that stay the same however often they are read, even if executors are lost: files in the shared folder.

    Spark removes them with the frame if spark.cleaner.referenceTracking.cleanCheckpoints is set, as `session` does.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Rows written as Parquet in the shared folder and read from there: for large tables, some times smaller than the files of `stable`, and read by columns. They stay there."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever it is stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
