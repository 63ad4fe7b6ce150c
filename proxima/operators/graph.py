"""G, X7, D4: graphs as edges(src, dst, w). Loops join DataFrames; each round's state is checkpointed."""

from __future__ import annotations

import math
from collections import Counter
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .ranks import ranked
from .state import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, the lightest of parallel ones, no loops."""
    both = edges.select("src", "dst", "w").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def adjacency(edges: DataFrame, by_weight: bool = False) -> DataFrame:
    """(src, dst, position) by dst, or by weight descending, positions from 1."""
    order = [F.desc("w"), "dst"] if by_weight else ["dst"]
    return edges.withColumn("position", F.row_number().over(Window.partitionBy("src").orderBy(*order)))


def degree(edges: DataFrame) -> DataFrame:
    """G7."""
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def _to_least(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions: every larger neighbour of a node goes to the least node that it knows, as (larger, least)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def stars(links: DataFrame) -> DataFrame:
    """links(a, b) of orderable ids: (id, component) with the least id of the component, for every id in a link.

    Alternating star operations: the larger neighbours of a node are linked to the least that it knows, then its smaller
    ones are; rounds grow with the logarithm of the longest path, in whatever order its ids are. Minima are pre-aggregated and
    a round's tables replace those of the one before.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        large = cut(_to_least(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.distinct(), edges, large)  # (larger, smaller)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = state


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster), the least id connected to each of vertices(id) over links(i, j); vertices without links are their own."""
    parts = stars(links.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return vertices.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def connected(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """One row (components, connected). A vertex without links is a component."""
    return components(vertices, links).agg(F.countDistinct("cluster").alias("components")).withColumn("connected", F.col("components") == 1)


def bfs(edges: DataFrame, start: int, target: int | None = None) -> DataFrame:
    """(id, hops, parent, visit) from start. edges hold both directions; parents are those visited first; visit counts the
    order in which a queue takes vertices, neighbours by weight descending, then id. With a target the search ends at its level."""
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst", "w"))
    seen = frontier = spark.createDataFrame([(start, 0, None, 1)], "id long, hops long, parent long, visit long")
    n, level = 1, 0
    while True:
        if target is not None and frontier.where(F.col("id") == target).limit(1).count():
            return seen
        level += 1
        # a vertex is taken by the first visited of its neighbours, as in a queue
        found = frontier.join(edges, frontier["id"] == edges["src"]).join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        first = found.groupBy("dst").agg(F.min_by(F.struct(F.col("src"), F.col("visit"), F.col("w")), F.struct("visit", -F.col("w"))).alias("m"))
        new = first.select(F.col("dst").alias("id"), F.lit(level).cast("long").alias("hops"), F.col("m.src").alias("parent"), F.struct(F.col("m.visit"), -F.col("m.w"), F.col("dst")).alias("o"))
        old, frontier = frontier, ranked(new, ["o"], "r").select("id", "hops", "parent", (F.col("r") + n).alias("visit"))
        frontier = cut(frontier, old)
        got = frontier.count()
        if not got:
            return seen
        n += got
        seen = cut(seen.unionByName(frontier), seen)


def shortest_paths(edges: DataFrame, start: int) -> DataFrame:
    """(id, dist, prev) by relaxing until nothing changes; weights above zero, both directions present."""
    edges = cut(edges.select("src", "dst", "w"))
    state = edges.sparkSession.createDataFrame([(start, 0.0, None)], "id long, dist double, prev long")
    moved = state
    while True:
        offers = moved.join(edges, moved["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("prev"))
        best = offers.groupBy("id").agg(F.min(F.struct("dist", "prev")).alias("m")).select("id", "m.dist", "m.prev")
        moved = cut(best.join(state.select("id", F.col("dist").alias("had")), "id", "left").where("had is null or dist < had").drop("had"), moved)
        if not moved.limit(1).count():
            return state
        state = cut(state.join(moved.select("id"), "id", "left_anti").unionByName(moved), state)


def label_propagation(vertices: DataFrame, links: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, cluster) after synchronous rounds: the most frequent label of a vertex's neighbours, ties to the least; lone vertices keep theirs."""
    links = cut(links.select("i", "j"))
    state = vertices.select("id", F.col("id").alias("cluster"))
    for _ in range(rounds):
        votes = links.join(state.select(F.col("id").alias("j"), "cluster"), "j").groupBy(F.col("i").alias("id"), "cluster").agg(F.count("*").alias("n"))
        top = votes.groupBy("id").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("voted"))
        state = cut(state.join(top, "id", "left").select("id", F.coalesce("voted", "cluster").alias("cluster")), state)
    return state


def spanning_tree(edges: DataFrame, root: int) -> DataFrame:
    """(parent, child) of a breadth-first tree from root."""
    return bfs(edges, root).where("parent is not null").select("parent", F.col("id").alias("child"))


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 1) -> DataFrame:
    """G1: a connected Erdos-Renyi graph over 1..n, both directions; seeds are tried in turn until it is connected."""
    ids = spark.range(1, n + 1)
    while True:
        pairs = ids.toDF("src").join(ids.toDF("dst"), F.col("src") < F.col("dst"))
        edges = cut(undirected(pairs.where(uniform(F.col("src"), F.col("dst"), seed) < p).withColumn("w", F.lit(1.0))))
        if connected(ids, edges.select(F.col("src").alias("i"), F.col("dst").alias("j"))).first()["connected"]:
            return edges
        seed += 1


def preferential_graph(spark: SparkSession, n: int, m0: int, m: int, seed: int = 1) -> DataFrame:
    """Preferential attachment over 1..n nodes of a cluster (few; built on the driver): m0 nodes in full, each later one linked
    to m earlier ones by degree, without replacement: those with the least -ln(1 - u) / degree, u a hash of both and the seed."""
    u = lambda *parts: int(md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32
    edges = [(a, b) for a in range(1, m0 + 1) for b in range(1, a)]
    degrees = Counter(x for e in edges for x in e)
    for v in range(m0 + 1, n + 1):
        for x in sorted(range(1, v), key=lambda x: (-math.log(1 - u(v, x, seed)) / max(1, degrees[x]), x))[:m]:
            edges.append((v, x))
        degrees = Counter(x for e in edges for x in e)
    return undirected(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, w double"))


def grid_graph(spark: SparkSession, n: int) -> DataFrame:
    """The n x n grid, vertices numbered by row from 1, both directions."""
    v = spark.range(n * n).select((F.col("id") + 1).alias("src"), (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = v.select("src", F.explode(steps).alias("d"), "x", "y").withColumns({"x": F.col("x") + F.col("d.dx"), "y": F.col("y") + F.col("d.dy")})
    return near.where(f"x between 0 and {n - 1} and y between 0 and {n - 1}").select("src", (F.col("y") * n + F.col("x") + 1).alias("dst"), F.lit(1.0).alias("w"))


def communication_cost(edges: DataFrame, points: int, dims: int, extra: float = 0.0) -> DataFrame:
    """What a coreset of that many points costs when every node sends it over every link, plus a further term."""
    return edges.agg(F.sum("w").alias("links")).select((F.col("links") * points * dims + extra).alias("cost"))
