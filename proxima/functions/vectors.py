"""Vector expressions over array<double> columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a, b) -> Column:
    """K5. Summed from differences, so never below zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a, b) -> Column:
    """K1."""
    return dot(a, b) / (norm(a) * norm(b))


def euclid_similarity(a, b) -> Column:
    """K2."""
    return 1.0 / (1.0 + distance(a, b))


def closeness(x) -> Column:
    """exp(-x^2)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.exp(-x * x)


def points(df: DataFrame, id_col: str, vector: str, label: str | None = None) -> DataFrame:
    """points(id, v[, label]) with double components; rows without id or vector are left out."""
    more = [F.col(label).alias("label")] if label else []
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)
