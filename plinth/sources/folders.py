"""Scratch folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, on one machine, one of our own where it is unset.

    The application's own checkpoints in it are deleted when it ends.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = getattr(context, "_plinth_shared", None)
        if where is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = context._plinth_shared = where or tempfile.mkdtemp(prefix="plinth-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    if not getattr(context, "_plinth_own", False):
        context._plinth_own = _until_exit(spark, context._jsc.sc().getCheckpointDir().get())
    return where


def _until_exit(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.mkdirs(path) and files.deleteOnExit(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    where = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _until_exit(spark, where)
    return where


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to a scratch folder and read from there."""
    where = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
