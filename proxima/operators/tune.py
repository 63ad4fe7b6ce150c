"""H: parameter grids. Similarities and neighbours are computed once, for the largest k; every configuration shares them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .density import snn_clusters
from .metrics import adjusted_rand, cvnn, homogeneity_completeness_v, silhouette, snn_distance_or
from .similarity import knn, snn
from .state import cut


def grid_counts(points: DataFrame, ks: list[int], eps: list[int], minpts: list[int], measure: str = "cosine") -> DataFrame:
    """H1: (k, eps, minpts, cores) of every configuration, in one job."""
    spark = points.sparkSession
    lists = cut(knn(points, max(ks), measure))
    graphs = None
    for k in ks:
        own = snn(lists.where(F.col("rk") <= k)).select(F.lit(k).alias("k"), "i", "w")
        graphs = own if graphs is None else graphs.unionAll(own)
    e = spark.createDataFrame([(x,) for x in eps], "eps int")
    dens = graphs.crossJoin(F.broadcast(e)).where("w >= eps").groupBy("k", "eps", "i").agg(F.count("*").alias("d"))
    grid = spark.createDataFrame([(k, x, m) for k in ks for x in eps for m in minpts], "k int, eps int, minpts int")
    m = spark.createDataFrame([(x,) for x in minpts], "minpts int")
    cores = dens.crossJoin(F.broadcast(m)).where("d >= minpts").groupBy("k", "eps", "minpts").agg(F.count("*").alias("cores"))
    return grid.join(cores, ["k", "eps", "minpts"], "left").select("k", "eps", "minpts", F.coalesce("cores", F.lit(0)).alias("cores"))


def grid_scores(points: DataFrame, ks: list[int], eps: list[int], minpts: list[int], measure: str = "cosine", truth: DataFrame | None = None, least_assigned: float = 0.4) -> DataFrame:
    """H1-H4: (k, eps, minpts, cores, assigned, silhouette, cvnn[, vm, ari]), null scores where no core point is found, too few
    points are assigned, or the index is undefined. truth(id, truth) adds the external indices."""
    spark, n, rows = points.sparkSession, points.count(), []
    lists = cut(knn(points, max(ks), measure))
    for k in ks:
        graph = cut(snn(lists.where(F.col("rk") <= k)))
        for x in eps:
            for m in minpts:
                a = cut(snn_clusters(points, graph, x, m))
                own = a.where("kind <> 'noise'")
                cores, assigned = a.agg(F.count(F.when(F.col("kind") == "core", 1)), F.count(F.when(F.col("kind") != "noise", 1))).first()
                sil = cv = vm = ari = None
                if cores and assigned >= least_assigned * n:
                    labels, d = own.select("id", "cluster"), snn_distance_or(graph, own, k)
                    sil, cv = silhouette(labels, d, float(k)).first()[0], cvnn(labels, d, float(k)).first()["cvnn"]
                    sil = None if sil is None or sil != sil else sil
                    if truth is not None:
                        pairs = cut(own.join(truth, "id").select(F.col("cluster").alias("pred"), "truth"))
                        vm, ari = homogeneity_completeness_v(pairs).first()["v_measure"], adjusted_rand(pairs).first()["ari"]
                rows.append((k, x, m, cores, assigned, sil, cv, vm, ari))
    return spark.createDataFrame(rows, "k int, eps int, minpts int, cores long, assigned long, silhouette double, cvnn double, vm double, ari double")


def best(grid: DataFrame, score: str = "silhouette", largest: bool = True) -> DataFrame:
    """The configuration with the best score, ties to the least (k, eps, minpts); no row if none has a score."""
    order = F.desc(score) if largest else F.asc(score)
    return grid.where(F.col(score).isNotNull()).orderBy(order, "k", "eps", "minpts").limit(1)


def repeated(run, seeds: list[int]) -> DataFrame:
    """H6: the union of run(seed), with the seed."""
    out = None
    for s in seeds:
        own = run(s).withColumn("seed", F.lit(s))
        out = own if out is None else out.unionByName(own)
    return out


def sigma_sweep(run, sigmas: list[float]) -> DataFrame:
    """H5: the union of run(sigma), with sigma."""
    out = None
    for s in sigmas:
        own = run(s).withColumn("sigma", F.lit(float(s)))
        out = own if out is None else out.unionByName(own)
    return out
