"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import cut


def ranked(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """df with `name`, gapless from 1 in the order of its columns: range partitions, their sizes, and ranks inside of each."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.join(F.broadcast(sizes), "__p").withColumn(name, (F.col("__b") + own).cast("long")).drop("__p", "__b")
