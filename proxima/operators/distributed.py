"""X: two-phase shared-neighbour clustering: local clusters per node, samples, a central graph, and votes for all points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .density import snn_clusters
from .graph import components, label_propagation
from .similarity import block_join, knn, snn, top_k
from .state import cut


def _least_hashes(df: DataFrame, by: list[str], share: float, seed: int, id_col: str) -> DataFrame:
    """The ceil(share * n) rows of every stratum with the least (hash, id), with __n, the stratum's size.

    A histogram of the hashes, with bins of some thousand rows, tells the bin in which a stratum's quota ends; rows below it are
    in, and only that bin's rows are ranked: no task gets all of a large stratum.
    """
    bins = max(1, -(-df.count() // 4096))
    free = lambda c: c if c not in df.columns else free(f"_{c}")
    u, k, end, open_, n = (free(c) for c in ("__u", "__k", "__end", "__open", "__n"))
    drawn = df.withColumn(u, uniform(F.col(id_col), seed)).withColumn(k, F.floor(F.col(u) * bins))
    per = drawn.groupBy(*by, k).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*by).orderBy(k).rowsBetween(Window.unboundedPreceding, 0))
    quota = per.withColumn("upto", upto).withColumn(n, F.sum("rows").over(Window.partitionBy(*by))).withColumn("quota", F.ceil(share * F.col(n)))
    ends = quota.where("upto >= quota").groupBy(*by, n).agg(F.min(F.struct(F.col(k).alias("k"), (F.col("quota") - F.col("upto") + F.col("rows")).alias("rest"))).alias("e")).select(*by, n, F.col("e.k").alias(end), F.col("e.rest").alias(open_))
    same = [f"__by{i}" for i in range(len(by))]
    at = drawn.join(ends.select(*[F.col(c).alias(s) for c, s in zip(by, same)], n, end, open_), [F.col(c).eqNullSafe(F.col(s)) for c, s in zip(by, same)])
    rank = F.row_number().over(Window.partitionBy(*by, k).orderBy(u, id_col))
    last = at.where(F.col(k) == F.col(end)).withColumn("__r", rank).where(F.col("__r") <= F.col(open_)).drop("__r")
    return at.where(F.col(k) < F.col(end)).unionByName(last).drop(u, k, end, open_, *same)


def stratified_sample(df: DataFrame, by: list[str], share: float, seed: int = 1, id_col: str = "id") -> DataFrame:
    """ceil(share * n) rows of every stratum, without replacement, those with the least hashes."""
    return _least_hashes(df, by, share, seed, id_col).select(*df.columns)


def inverse_size_sample(df: DataFrame, node: str, cluster: str, share: float, seed: int = 1, id_col: str = "id") -> DataFrame:
    """ceil(share * n) rows per (node, cluster), with weight ((1 - n_cluster / n_node) / 2) / n_cluster, zero for a lone cluster."""
    nn = df.groupBy(node).agg(F.count("*").alias("__nn"))
    s = _least_hashes(df, [node, cluster], share, seed, id_col).join(nn, node)
    return s.withColumn("weight", (1 - F.col("__n") / F.col("__nn")) / 2 / F.col("__n")).select(*df.columns, "weight")


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int = 1, id_col: str = "id") -> DataFrame:
    """N rows without replacement by weight: those with the least -ln(u) / weight."""
    return df.where(F.col(weight) > 0).withColumn("__k", -F.log(1 - uniform(F.col(id_col), seed)) / F.col(weight)).orderBy("__k", id_col).limit(n).drop("__k")


def local_clusters(points: DataFrame, k: int, eps: int, minpts: int, measure: str = "cosine") -> DataFrame:
    """points(id, v, node) clustered inside of their nodes: (id, node, cluster, kind). Ids are unique over all nodes, so only
    the neighbour lists need the node as a key; everything after them stays inside a node by itself."""
    local = cut(snn(knn(points, k, measure, keys=["node"]), keys=["node"]).select("i", "j", "w"))
    return points.select("id", "node").join(snn_clusters(points, local, eps, minpts), "id")


def gathered(local: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """(id, node, cluster, kind): the core points, and of each local cluster a sample of its border points; noise stays away."""
    border = stratified_sample(local.where("kind = 'border'"), ["node", "cluster"], share, seed)
    return local.where("kind = 'core'").unionByName(border.select(*local.columns))


def central_graph(points: DataFrame, sample: DataFrame, k: int, cut_point: int, measure: str = "cosine") -> DataFrame:
    """links(i, j, w) of the gathered points with more than cut_point shared neighbours."""
    own = points.join(sample.select("id"), "id", "left_semi")
    return snn(knn(own, k, measure)).where(F.col("w") > cut_point)


def central_labels(sample: DataFrame, links: DataFrame, rounds: int | None = 5) -> DataFrame:
    """(id, cluster) of the gathered points, by label propagation, or by components if rounds is None."""
    v = sample.select("id")
    return components(v, links) if rounds is None else label_propagation(v, links, rounds)


def core_votes(points: DataFrame, cores: DataFrame, k: int = 3, measure: str = "cosine") -> DataFrame:
    """(id, cluster) of every point: cores(id, cluster) keep theirs, others take the majority of their k most similar cores,
    ties to the cluster that comes first in order of similarity. With fewer cores than k all of them vote."""
    c = points.join(cores, "id").select("id", "v", "cluster")
    others = points.join(cores.select("id"), "id", "left_anti").select("id", "v")
    near = top_k(block_join(others, c.select("id", "v"), measure, k=k), k).join(cores.select(F.col("id").alias("j"), "cluster"), "j")
    votes = near.groupBy("i", "cluster").agg(F.count("*").alias("n"), F.min("rk").alias("first"))
    won = votes.groupBy(F.col("i").alias("id")).agg(F.max_by("cluster", F.struct("n", -F.col("first"))).alias("cluster"))
    return cores.select("id", "cluster").unionByName(won)


def path_votes(links: DataFrame, cores: DataFrame, k: int) -> DataFrame:
    """(id, cluster, dist) of the core nearest by paths over links(i, j, w) of length k - w; ties to the least cluster."""
    edges = cut(links.select("i", "j", (F.lit(k) - F.col("w")).cast("double").alias("d")))
    state, moved = cores.select("id", "cluster", F.lit(0.0).alias("dist")), cores.select("id", "cluster", F.lit(0.0).alias("dist"))
    while True:
        offers = moved.join(edges, moved["id"] == edges["i"]).select(F.col("j").alias("id"), F.struct((F.col("dist") + F.col("d")).alias("dist"), F.col("cluster").alias("cluster")).alias("o"))
        best = offers.groupBy("id").agg(F.min("o").alias("o")).select("id", "o.cluster", "o.dist")
        had = state.select("id", F.struct("dist", "cluster").alias("had"))
        moved = cut(best.join(had, "id", "left").where(F.col("had").isNull() | (F.struct("dist", "cluster") < F.col("had"))).drop("had"), moved)
        if not moved.limit(1).count():
            return state
        state = cut(state.join(moved.select("id"), "id", "left_anti").unionByName(moved), state)


def two_phase(points: DataFrame, k: int, eps: int, minpts: int, share: float, central_k: int = 50, cut_point: int = 5, voters: int = 3, rounds: int | None = 5, measure: str = "cosine", seed: int = 1) -> DataFrame:
    """(id, cluster) of points(id, v, node)."""
    sample = cut(gathered(local_clusters(points, k, eps, minpts, measure), share, seed))
    links = cut(central_graph(points, sample, central_k, cut_point, measure))
    labels = cut(central_labels(sample, links, rounds))
    return core_votes(points, labels, voters, measure)


def two_phase_snn(points: DataFrame, k: int, eps: int, minpts: int, share: float, central_k: int | None = None, measure: str = "cosine", seed: int = 1) -> DataFrame:
    """(id, cluster, kind) of the sampled points: local clusters, an inverse-size sample, and clusters of the sample."""
    local = local_clusters(points, k, eps, minpts, measure).where("kind <> 'noise'")
    sample = cut(inverse_size_sample(local, "node", "cluster", share, seed))
    own = points.join(sample.select("id"), "id", "left_semi")
    return snn_clusters(own, cut(snn(knn(own, central_k or k, measure))), eps, minpts)
