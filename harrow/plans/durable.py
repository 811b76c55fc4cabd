"""Cutting lineage so that lost executors cost no result: tables in the folder that all executors share.

The folder is that of spark.checkpoint.dir. Only a local session without that setting, as in tests, gets a temporary
folder, which goes when the process ends; on a cluster its lack is an error, as executors could not read what others
wrote. A job on a cluster calls release() when it needs its tables no more.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below spark.checkpoint.dir."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="harrow-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder; later jobs read the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies; a missing one is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete a table that cut() gave; what was planned on it cannot run any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in path:
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all that this application has cut; DataFrames built on it cannot run any more."""
    if spark.sparkContext.getCheckpointDir():
        remove(spark, spark.sparkContext.getCheckpointDir())
