"""K: similarity joins and nearest neighbours.

Dense all-pairs work runs block against block: vectors are dealt to blocks, each pair of blocks meets in one task, numpy
multiplies them, and only pairs over a threshold or a partial top k leave it. Sparse vectors join on shared features.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
#: Decimals that similarities are compared with; smaller differences are ties, and go to the smaller id.
TIE = 12


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for i, x in enumerate(a):
        d = b - x
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


MEASURES: dict[str, Callable] = {
    "cosine": _cosine,
    "euclidean": lambda a, b: 1 / (1 + np.sqrt(_squared(a, b))),
    "dot": lambda a, b: a @ b.T,
    "neg_sqdist": lambda a, b: -_squared(a, b),
}


def measure_of(name: str) -> Callable:
    """K4. Unknown names raise."""
    if name not in MEASURES:
        raise ValueError(f"unknown similarity {name!r}; known: {sorted(MEASURES)}")
    return MEASURES[name]


def usable(points: DataFrame, measure: str) -> DataFrame:
    """Without vectors of length zero where the measure divides by the length."""
    if measure != "cosine":
        return points
    return points.where(F.exists("v", lambda x: x != 0))


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest of every row, by value descending, ties at TIE decimals to the smaller id."""
    if s.shape[1] > k:
        # what rounds to the kth value or more; only this is sorted
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        rows, cols = np.nonzero((s >= (least - 2 * 10.0**-TIE)[:, None]) & (s > -np.inf))
    else:
        rows, cols = np.nonzero(s > -np.inf)
    order = np.lexsort((ids[cols], -np.round(s[rows, cols], TIE), rows))
    rows, cols = rows[order], cols[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], cols[nth < k]


def block_join(left: DataFrame, right: DataFrame, measure: str, k: int | None = None, at_least: float | None = None, once: bool = False, block: int = BLOCK, keys: list[str] = ()) -> DataFrame:
    """(i, j, s) between left(id, v) and right(id, v), i <> j: the k best j per pair of blocks and i, or all with s >= at_least.

    once: only i < j. keys: further columns of both sides that must be equal, returned first.
    """
    fn, keys = measure_of(measure), list(keys)
    left, right = usable(left, measure), usable(right, measure)
    n_left, n_right = (max(1, -(-df.count() // block)) for df in (left, right))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    l = left.select(*keys, "id", "v", own(n_left).alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("bj"))
    # other names than on the left: both sides may be the same table
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in keys], F.col("id").alias("r_id"), F.col("v").alias("r_v"), own(n_right).alias("r_bj"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("r_bi"))
    types = {f.name: f.dataType.simpleString() for f in left.schema}

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({**{c: [] for c in keys}, "i": [], "j": [], "s": []})
        ia, ib = a["id"].to_numpy(), b["r_id"].to_numpy()
        s = fn(np.stack(a["v"].to_numpy()), np.stack(b["r_v"].to_numpy()))
        skip = ia[:, None] >= ib[None, :] if once else ia[:, None] == ib[None, :]
        s = np.where(skip, -np.inf, s)
        if k is not None:
            rows, cols = best(s, ib, k)
        else:
            rows, cols = np.nonzero(s >= (-np.inf if at_least is None else at_least))
        v = s[rows, cols]
        ok = v > -np.inf
        return pd.DataFrame({**{c: a[c].iloc[0] for c in keys}, "i": ia[rows[ok]], "j": ib[cols[ok]], "s": v[ok]})

    schema = "".join(f"{c} {types[c]}, " for c in keys) + "i long, j long, s double"
    by = [*keys, "bi", "bj"]
    return l.groupBy(*by).cogroup(r.groupBy(*[f"r_{c}" for c in by])).applyInPandas(pairs, schema)


def top_k(sim: DataFrame, k: int, keys: list[str] = ()) -> DataFrame:
    """K6-K8: knn(i, j, s, rk) of sim(i, j, s): by s descending, ties to the smaller j. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys, "i").orderBy(F.round("s", TIE).desc(), "j")
    return sim.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def knn(points: DataFrame, k: int, measure: str = "cosine", keys: list[str] = ()) -> DataFrame:
    """K6, K9: the k nearest other points of every point."""
    return top_k(block_join(points, points, measure, k=k, keys=keys), k, keys)


def threshold_pairs(points: DataFrame, at_least: float, measure: str = "cosine") -> DataFrame:
    """Pairs i < j with similarity at_least or more."""
    return block_join(points, points, measure, at_least=at_least, once=True)


def similarity_minmax(distances: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """distances(i, j, d) scaled to 1 - (d - min) / (max - min) over all pairs, or to ends(lo, hi); all ones where all are equal."""
    if ends is None:
        ends = distances.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    s = F.when(F.col("hi") > F.col("lo"), 1 - (F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return distances.crossJoin(F.broadcast(ends)).select("i", "j", s.alias("s"))


def index_join(features: DataFrame, symmetric: bool = True, diagonal: bool = False, max_df: int | None = None) -> DataFrame:
    """sim(i, j, s), dot products of features(id, term, w) over shared terms.

    symmetric mirrors i < j; diagonal adds (i, i, 1). A term in df documents makes df^2 / 2 partial products; max_df leaves
    out terms in more documents, which changes results and is therefore off by default.
    """
    if max_df is not None:
        features = features.join(features.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df).select("term"), "term", "left_semi")
    a, b = features.select("term", F.col("id").alias("i"), F.col("w").alias("a")), features.select("term", F.col("id").alias("j"), F.col("w").alias("b"))
    s = a.join(b, "term").where("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    if symmetric:
        s = s.unionAll(s.select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    if diagonal:
        s = s.unionAll(features.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("s")).distinct())
    return s


def snn(knn_: DataFrame, keys: list[str] = ()) -> DataFrame:
    """snn(i, j, w), w >= 1: shared neighbours of two points, in both directions."""
    a = knn_.select(*keys, F.col("i"), F.col("j").alias("n"))
    b = knn_.select(*keys, F.col("i").alias("j"), F.col("j").alias("n"))
    return a.join(b, [*keys, "n"]).where("i <> j").groupBy(*keys, "i", "j").agg(F.count("*").alias("w"))


def snn_lookup(snn_: DataFrame, i: int, j: int) -> DataFrame:
    """N5."""
    return snn_.where((F.col("i") == i) & (F.col("j") == j))


def snn_distance(snn_: DataFrame, k: int) -> DataFrame:
    """(i, j, d) with d = k - w for pairs that share a neighbour; all other pairs are at distance k."""
    return snn_.select("i", "j", (F.lit(k) - F.col("w")).alias("d"))
