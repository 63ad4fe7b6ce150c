"""Golden graphs, invariants and edge cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxima.functions import vectors as V
from proxima.operators import coreset as C
from proxima.operators import density as D
from proxima.operators import distributed as X
from proxima.operators import generators as R
from proxima.operators import graph as G
from proxima.operators import metrics as M
from proxima.operators import partition as P
from proxima.operators import pca as A
from proxima.operators import similarity as K
from proxima.operators import tune as H
from proxima.operators.ranks import ranked

HOPS = [(1, 2), (1, 9), (9, 3), (9, 7), (3, 4), (3, 5), (3, 6), (7, 6), (7, 8), (5, 8)]
PATHS = [(1, 2, 8), (1, 3, 2), (1, 4, 5), (2, 4, 2), (2, 6, 13), (3, 4, 2), (3, 5, 5), (4, 5, 1), (4, 6, 6), (4, 7, 3), (5, 7, 1), (6, 7, 2), (6, 8, 3), (7, 8, 6)]


def edges(spark, rows):
    return G.undirected(spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double"))


def cloud(spark, n=60, d=5, seed=0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, r.normal(size=d).tolist()) for i in range(n)], "id long, v array<double>")


def test_bfs_golden(spark):
    got = {r["id"]: (r["hops"], r["visit"]) for r in G.bfs(edges(spark, [(a, b, 1) for a, b in HOPS]), 1).collect()}
    assert [got[i][0] for i in range(1, 10)] == [0, 1, 2, 3, 3, 3, 2, 3, 1]
    assert sorted(got, key=lambda i: got[i][1]) == [1, 2, 9, 3, 7, 4, 5, 6, 8]
    assert G.bfs(edges(spark, [(a, b, 1) for a, b in HOPS]), 1, target=9).count() == 3


def test_dijkstra_golden(spark):
    got = {r["id"]: r["dist"] for r in G.shortest_paths(edges(spark, PATHS), 1).collect()}
    assert [got[i] for i in range(1, 9)] == [0, 6, 2, 4, 5, 8, 6, 11]


def test_snn_micro_case(spark):
    knn = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (4, 2), (4, 3)], "i long, j long")
    w = {(r["i"], r["j"]): r["w"] for r in K.snn(knn).collect()}
    assert {k: v for k, v in w.items() if k[0] < k[1]} == {(1, 2): 1, (1, 3): 1, (1, 4): 2, (2, 3): 1, (2, 4): 1, (3, 4): 1}
    assert all(w[j, i] == v for (i, j), v in w.items())


def test_knn_over_several_blocks_and_ties(spark):
    p = cloud(spark, 50).unionByName(cloud(spark, 50).select((F.col("id") + 50).alias("id"), "v"))  # every vector twice
    one = {(r["i"], r["j"], r["rk"]) for r in K.top_k(K.block_join(p, p, "cosine", k=4), 4).collect()}
    many = {(r["i"], r["j"], r["rk"]) for r in K.top_k(K.block_join(p, p, "cosine", k=4, block=13), 4).collect()}
    assert one == many and len(one) == 400
    assert {(i, j) for i, j, rk in one if rk == 1 and i < 50} == {(i, i + 50) for i in range(50)}


def test_zero_vectors_and_unknown_names(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (None, [1.0, 1.0]), (5, None)], "id long, v array<double>")
    got = K.knn(V.points(p, "id", "v"), 2).collect()
    assert {(r["i"], r["j"]) for r in got} == {(2, 3), (3, 2)}
    with pytest.raises(ValueError):
        K.measure_of("nothing")
    with pytest.raises(ValueError):
        P.partition("nothing", p, 2)


def test_empty_points(spark):
    p = spark.createDataFrame([], "id long, v array<double>")
    assert D.cluster_points(p, 3, 1, 1).count() == 0


def test_core_set_shrinks(spark):
    p = cloud(spark)
    s = K.snn(K.knn(p, 8)).cache()
    counts = [[D.core_points(D.density(p, s, eps), m).count() for m in (1, 3, 6)] for eps in (1, 3, 5)]
    assert all(a >= b for row in counts for a, b in zip(row, row[1:])) and all(a >= b for x, y in zip(counts, counts[1:]) for a, b in zip(x, y))
    assert s.agg(F.max("w")).first()[0] <= 8


def test_labels_do_not_depend_on_order(spark):
    p = cloud(spark)
    a = {tuple(r) for r in D.cluster_points(p, 8, 3, 3).collect()}
    assert a == {tuple(r) for r in D.cluster_points(p.orderBy(F.desc("id")).repartition(7), 8, 3, 3).collect()}


def test_one_hop_rule(spark):
    """A path 1-2-3-4-5: 1 takes 2; 3 begins anew and takes 4; 5 is alone."""
    core = spark.range(1, 6)
    links = edges(spark, [(i, i + 1, 1) for i in range(1, 5)]).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    assert {r["id"]: r["cluster"] for r in D.one_hop(core, links).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_components_of_a_long_path(spark):
    links = edges(spark, [(i, i + 1, 1) for i in range(200)]).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    got = G.components(spark.range(203), links).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == {0: 201, 201: 1, 202: 1}


def test_rounds_are_few_on_a_shuffled_path(spark, monkeypatch):
    """3000 points in a row whose ids are in no order: rounds follow the logarithm, and state is read from files of its own size."""
    ids = list(range(3000))
    random.Random(1).shuffle(ids)
    one = spark.createDataFrame([(ids[k], ids[k + 1]) for k in range(2999)], "i long, j long")
    cuts, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, *old: cuts.append(cut(df, *old)) or cuts[-1])
    got = G.components(spark.range(3002), one).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == {0: 3000, 3000: 1, 3001: 1}
    assert len(cuts) <= 2 * 20
    assert all(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10_000_000 for df in cuts[-2:])


def test_repeated_rows_count_apart(spark):
    p = spark.createDataFrame([(1, [0.0], 1.0), (1, [0.0], 1.0), (3, [4.0], 1.0)], "id long, v array<double>, w double")
    c = spark.createDataFrame([(1, [1.0])], "centre int, c array<double>")
    assert sorted(r["cost"] for r in C.nearest_centre(p, c).collect()) == [1.0, 1.0, 9.0]
    assert C.kmeans_cost(p, c).first()[0] == 11.0
    made = C.coreset(p, c, 2)
    assert abs(made.agg(F.sum("w")).first()[0] - 3) < 1e-9
    assert C.nearest_centre(p, c.where("false")).where("centre is null and cost is null").count() == 3


def test_samples_of_a_hot_stratum(spark):
    """A stratum of many rows, beside a small one and one without a name, has the rows with the least hashes, as many as asked for."""
    from proxima.functions.hashing import uniform

    df = spark.range(9000).select("id", F.when(F.col("id") < 8990, "hot").when(F.col("id") < 8995, "cold").alias("s"))
    want = {}
    for r in df.withColumn("u", uniform(F.col("id"), 1)).collect():
        want.setdefault(r["s"], []).append((r["u"], r["id"]))
    want = {k: {i for _, i in sorted(v)[: math.ceil(0.1 * len(v))]} for k, v in want.items()}
    got = {}
    for r in X.stratified_sample(df, ["s"], 0.1).collect():
        got.setdefault(r["s"], set()).add(r["id"])
    assert got == want


def test_best_of_runs_is_the_cheapest(spark):
    p = cloud(spark, 90).withColumn("w", F.lit(1.0))
    costs = [C.kmeans_cost(p, C.lloyd(p, C.kmeans_pp(p, 3, s), 5, "w")).first()[0] for s in (1, 2, 3)]
    assert abs(C.kmeans_cost(p, C.best_lloyd(p, 3, rounds=5, runs=3)).first()[0] - min(costs)) < 1e-9


def test_dbscan_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.uniform(size=(150, 2))
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    got = {r["id"]: (r["cluster"], r["kind"]) for r in D.dbscan(p, 0.08, 4, ["x", "y"]).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.08**2
    core = near.sum(1) >= 4
    for i in range(150):
        assert (got[i][1] == "core") == core[i]
        assert (got[i][1] == "noise") == (not (near[i] & core).any())
    for i in range(150):
        for j in range(150):
            if core[i] and core[j] and near[i, j]:
                assert got[i][0] == got[j][0]


def test_scores_of_equal_and_independent_labels(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "pred int, truth int")
    s = M.scores(same).first()
    assert all(abs(s[k] - 1) < 1e-6 for k in ("P", "ARI", "AMI", "NMI", "H", "C", "VM")) and abs(s["E"]) < 1e-6
    mixed = spark.createDataFrame([(i % 3, i // 3 % 3) for i in range(90)], "pred int, truth int")
    s = M.scores(mixed).first()
    assert abs(s["VM"]) < 1e-9 and s["ARI"] < 0 and s["AMI"] < 0


def test_silhouette_of_one_cluster_is_nan(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster long")
    d = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "i long, j long, d double")
    assert math.isnan(M.silhouette(labels, d, 5.0).first()[0])


def test_ranks_are_gapless(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = ranked(df, ["k", "id"], "r").orderBy("r").collect()
    assert [r["r"] for r in got] == list(range(1, 1001)) and [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_partitions_cover_all(spark):
    p = cloud(spark, 200)
    for kind, options in (("balanced", {}), ("uniform", {}), ("unbalanced", {}), ("weighted", {}), ("similarity", {}), ("degree", {"edges": G.grid_graph(spark, 2)})):
        nodes = [r["node"] for r in P.partition(kind, p, 4, **options).collect()]
        assert len(nodes) == 200 and set(nodes) <= {1, 2, 3, 4}
    assert max(np.bincount([r["node"] for r in P.partition("balanced", p, 3).collect()])[1:]) == 67
    r = P.partition("range", p.withColumn("x", F.col("v")[0]), 4, column="x").groupBy("node").count().collect()
    assert len(r) == 4 and max(x["count"] for x in r) <= 60


def test_votes_with_fewer_cores_than_voters(spark):
    p = cloud(spark, 20)
    got = X.core_votes(p, spark.createDataFrame([(0, 7)], "id long, cluster long"), 3).collect()
    assert len(got) == 20 and {r["cluster"] for r in got} == {7}


def test_path_votes(spark):
    links = edges(spark, [(1, 2, 3), (2, 3, 3), (3, 4, 1), (4, 5, 3)]).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("long").alias("w"))
    got = {r["id"]: (r["cluster"], r["dist"]) for r in X.path_votes(links, spark.createDataFrame([(1, 1), (5, 5)], "id long, cluster long"), 4).collect()}
    assert got == {1: (1, 0.0), 2: (1, 1.0), 3: (1, 2.0), 4: (5, 1.0), 5: (5, 0.0)}


def test_coreset_mass(spark):
    p = cloud(spark, 100).withColumns({"w": F.lit(1.0), "node": (F.col("id") % 3 + 1).cast("int")})
    c = C.single_swap(p, 2, runs=1)
    made = C.distributed_coreset(p, c, 30).groupBy("node").agg(F.sum("w").alias("w"), F.sum(F.col("is_center").cast("int")).alias("k")).collect()
    assert {r["node"]: round(r["w"], 6) for r in made} == {1: 34, 2: 33, 3: 33} and all(r["k"] == 2 for r in made)
    small = C.distributed_coreset(p, c, 3000)
    assert small.count() == 100 and small.where("is_center").count() == 0


def test_kmeans_improves(spark):
    p = cloud(spark, 80).withColumn("w", F.lit(1.0))
    start = C.kmeans_pp(p, 4)
    cost = [C.kmeans_cost(p, C.lloyd(p, start, n, "w")).first()[0] for n in (0, 1, 4)]
    assert cost[0] >= cost[1] >= cost[2] and start.count() == 4


def test_pca_and_projection(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 4)) * [5, 3, 1, 0.1]
    p = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, v array<double>, node int")
    values = [r["eigenvalue"] for r in A.principal_components(p.select("id", "v"), 4).collect()]
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x.T) * 199))[::-1])
    assert np.allclose([r["eigenvalue"] for r in A.distributed_pca(p, 4, 2).collect()], values[:2])
    c = A.centred(p.select("id", "v"))
    low = A.back_project(A.project(c, A.principal_components(c, 2)), A.principal_components(c, 2))
    left = c.join(low.withColumnRenamed("v", "b"), "id").agg(F.sum(V.squared_distance("v", "b"))).first()[0]
    assert abs(left - sum(values[2:])) < 1e-6


def test_spectral_finds_blobs(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.2, (15, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["centre"] for r in A.spectral_clusters(p, 3, 0.7).collect()}
    assert [len({got[i] for i in range(a, a + 15)}) for a in (0, 15, 30)] == [1, 1, 1] and len(set(got.values())) == 3


def test_generators_and_reports(spark):
    assert R.cure(spark, 50).groupBy("label").count().count() == 7
    m = R.circles(spark, 400).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1] - 1) < 1e-9
    lines = [r["line"] for r in R.report(spark.createDataFrame([("b", 0.5), ("a", None)], "k string, x double"), "latex").orderBy("row").collect()]
    assert lines == [r"k & x \\", r"a &  \\", r"b & 0.5000 \\"]


def test_grid_and_repeats(spark):
    p = cloud(spark)
    g = H.grid_scores(p, [8], [2, 3], [2], least_assigned=0.1).cache()
    assert g.count() == 2 and H.best(g).count() <= 1
    runs = H.repeated(lambda s: P.uniform_nodes(p, 3, s).groupBy("node").count(), [1, 2])
    assert M.mean_std(runs, ["node"], "count").count() == 3
    assert H.sigma_sweep(lambda s: A.affinity(p, s).agg(F.sum("a").alias("a")), [0.5, 1.0]).count() == 2


def test_local_search_holds_no_matrix_of_a_node():
    import tracemalloc

    r = np.random.default_rng(0)
    n = 5000
    x = r.normal(size=(n, 8)) + 6 * r.normal(size=(5, 8))[r.integers(0, 5, n)]
    tracemalloc.start()
    own = C._swap(x, np.ones(n), r.random((1, n)), 3, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = ((x[:, None, :] - x[None, own, :]) ** 2).sum(2)
    others = ((x[:, None, :] - x[None, ::50, :]) ** 2).sum(2)
    cost = d.min(1).sum()
    for out in range(3):  # no exchange saves over one per cent
        rest = np.delete(d, out, 1).min(1)
        assert np.minimum(others, rest[:, None]).sum(0).min() >= 0.99 * cost - 1e-6
    assert most < 8 * n * n
