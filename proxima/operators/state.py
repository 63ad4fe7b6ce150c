"""Cutting the lineage of iterations: state is a table in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, and only on a local master, a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    at = f"file://{os.path.join(tempfile.gettempdir(), f'proxima-{spark.sparkContext.applicationId}')}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def remove(spark: SparkSession, at: str) -> None:
    """Removes a file or folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/proxima-state-{spark.sparkContext.applicationId}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of a query that ends in here go at once; else they stay until the driver's garbage collector finds them unused."""
    before = spark.conf.get(CLEANUP)  # a default given here would hide the one that Spark has
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, *old: DataFrame) -> DataFrame:
    """df computed once and read back as a table below the shared folder; tables of earlier cuts in `old` are removed.

    A reader of the table starts from its files: neither lineage nor size estimates grow from round to round, and lost
    executors lose nothing. (A checkpoint() keeps the estimate of the plan that made it, and joins multiply estimates.)
    """
    spark = df.sparkSession
    at = f"{_root(spark)}/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.cut_at = at
    forget(*old)
    return out


def forget(*old: DataFrame) -> None:
    """Removes the tables of earlier cuts; other DataFrames are left alone."""
    for df in old:
        if at := getattr(df, "cut_at", None):
            remove(df.sparkSession, at)


def clear(spark: SparkSession) -> None:
    """Removes all that cuts of this application have left; results that still read from it can't be read any more."""
    remove(spark, _root(spark))
