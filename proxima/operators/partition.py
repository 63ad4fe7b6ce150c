"""P: partitioners. All add a column node, 1..n; random ones draw from hashes of id and seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.vectors import squared_distance
from .ranks import ranked


def balanced(df: DataFrame, n: int, seed: int = 1, id_col: str = "id") -> DataFrame:
    """Shuffled round robin, sizes at most one apart."""
    r = ranked(df.withColumn("__u", uniform(F.col(id_col), seed)), ["__u", id_col], "__r")
    return r.withColumn("node", ((F.col("__r") - 1) % n + 1).cast("int")).drop("__u", "__r")


def uniform_nodes(df: DataFrame, n: int, seed: int = 1, id_col: str = "id") -> DataFrame:
    """P1."""
    return df.withColumn("node", (F.floor(uniform(F.col(id_col), seed) * n) + 1).cast("int"))


def _by_shares(u: Column, shares: list[float]) -> Column:
    total, sofar, out = sum(shares), 0.0, F.lit(len(shares))
    cuts = []
    for s in shares[:-1]:
        sofar += s / total
        cuts.append(sofar)
    for node, cut in reversed(list(enumerate(cuts, 1))):
        out = F.when(u < cut, node).otherwise(out)
    return out.cast("int")


def unbalanced(df: DataFrame, n: int, seed: int = 1, id_col: str = "id", factor: float = 20.0) -> DataFrame:
    """The first half of the nodes gets `factor` times the share of the others."""
    return df.withColumn("node", _by_shares(uniform(F.col(id_col), seed), [factor if i < n // 2 else 1.0 for i in range(n)]))


def similarity_nodes(points: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """N pivots by hash; a point goes to pivot p with probability proportional to exp(-d^2 / mean d^2). The pivots are n rows."""
    pivots = points.withColumn("u", uniform(F.col("id"), seed, "pivot")).orderBy("u", "id").limit(n).select("id", F.col("v").alias("pv"))
    pivots = pivots.withColumn("node", F.row_number().over(Window.orderBy("id")).cast("int")).select("node", "pv")
    d = points.crossJoin(F.broadcast(pivots)).withColumn("d2", squared_distance("v", "pv"))
    per = d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("node", "d2"))).alias("ds"))
    mean = F.aggregate("ds", F.lit(0.0), lambda a, x: a + x["d2"]) / F.size("ds")
    per = per.withColumn("mean", mean).withColumn("ps", F.transform("ds", lambda x: F.exp(-x["d2"] / F.greatest(F.col("mean"), F.lit(1e-300)))))
    target = uniform(F.col("id"), seed) * F.aggregate("ps", F.lit(0.0), lambda a, x: a + x)
    walk = F.aggregate("ps", F.struct(F.lit(0.0).alias("sum"), F.lit(1).alias("node")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.when(a["sum"] + x <= F.col("target"), a["node"] + 1).otherwise(a["node"]).alias("node")))
    return points.join(per.withColumn("target", target).select("id", F.least(walk["node"], F.lit(n)).alias("node")), "id")


def weighted(df: DataFrame, weights: list[float], seed: int = 1, id_col: str = "id") -> DataFrame:
    """Node i with probability proportional to |weights[i]|."""
    return df.withColumn("node", _by_shares(uniform(F.col(id_col), seed), [abs(w) for w in weights]))


def normal_weights(n: int, seed: int = 1) -> list[float]:
    """|N(0, 1)| draws for P4, from a linear congruence so that they are the same everywhere."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        y = (1103515245 * x + 12345) % 2**31
        out.append(abs(math.sqrt(-2 * math.log((x + 1) / (2**31 + 1))) * math.cos(2 * math.pi * y / 2**31)))
        x = y
    return out


def by_degree(df: DataFrame, edges: DataFrame, seed: int = 1, id_col: str = "id") -> DataFrame:
    """P5: node by its degree in the network, whose few nodes are 1..n."""
    degrees = {r["src"]: r["d"] for r in edges.groupBy("src").agg(F.count("*").alias("d")).collect()}
    return weighted(df, [degrees.get(i, 0) for i in range(1, max(degrees) + 1)], seed, id_col)


def range_nodes(df: DataFrame, n: int, column: str, bins: int = 20) -> DataFrame:
    """Cuts at equal counts, interpolated inside a histogram of bins * n equal bins; ends belong to the first range that has them."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    total_bins = bins * n
    if lo is None or lo == hi:
        return df.withColumn("node", F.lit(1))
    width = (hi - lo) / total_bins
    b = F.least(F.floor((F.col(column) - lo) / width), F.lit(total_bins - 1)).cast("int")
    counts = {r["b"]: r["n"] for r in df.where(F.col(column).isNotNull()).groupBy(b.alias("b")).agg(F.count("*").alias("n")).collect()}  # bins * n rows at most
    total, sofar, cuts, target = sum(counts.values()), 0, [], 1
    for i in range(total_bins):
        c = counts.get(i, 0)
        while target < n and c and sofar + c >= target * total / n:
            cuts.append(lo + width * (i + (target * total / n - sofar) / c))
            target += 1
        sofar += c
    node = F.lit(n)
    for k, cut in reversed(list(enumerate(cuts, 1))):
        node = F.when(F.col(column) <= cut, k).otherwise(node)
    return df.withColumn("node", node.cast("int"))


def partition(kind: str, df: DataFrame, n: int, **options) -> DataFrame:
    """P0. Unknown kinds raise."""
    if kind == "weighted":
        return weighted(df, options.pop("weights", None) or normal_weights(n, options.get("seed", 1)), **options)
    if kind == "degree":
        return by_degree(df, options.pop("edges"), **options)
    kinds = {"balanced": balanced, "uniform": uniform_nodes, "unbalanced": unbalanced, "similarity": similarity_nodes, "range": range_nodes}
    if kind not in kinds:
        raise ValueError(f"unknown partition {kind!r}; known: {sorted([*kinds, 'weighted', 'degree'])}")
    return kinds[kind](df, n, **options)
