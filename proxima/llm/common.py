"""Shared helpers: the cluster's shared folder, checkpoints and whole-table scans."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import remove, shared_dir  # noqa: F401

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/proxima-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder (a reliable checkpoint)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches that Python stages get, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 10000) > rows:
        spark.conf.set(key, str(rows))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of words of each): lower-cased A-Z, parted at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    empty = pc.binary_length(words).to_numpy(zero_copy_only=False) == 0  # the one "word" of a text without any
    if empty.any():
        sizes[pc.binary_length(pc.ascii_trim_whitespace(texts)).to_numpy(zero_copy_only=False) == 0] = 0
        words = words.filter(pa.array(~empty))
    return words.cast(pa.binary()), sizes
