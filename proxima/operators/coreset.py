"""K-means and weighted coresets.

Centres are arrays in a DataFrame of k rows, which is what is broadcast; k is a parameter of the call. Points are
points(id, v[, w]) throughout; draws come from hashes of id, seed and round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.vectors import squared_distance
from .state import cut


def repaired_weights(df: DataFrame, weight: str = "w") -> DataFrame:
    """Absolute weights, all one if they add up to nothing."""
    total = df.agg(F.coalesce(F.sum(F.abs(weight)), F.lit(0.0)).alias("__t"))
    return df.crossJoin(F.broadcast(total)).withColumn(weight, F.when(F.col("__t") > 0, F.abs(weight)).otherwise(1.0)).drop("__t")


def _centre_list(centres: DataFrame, *by: str) -> DataFrame:
    """One row (per `by`) with all centres; their number is a parameter of the call, and so bounds what is broadcast."""
    return centres.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("centre", "c"))).alias("__centres"))


def _nearest(points: DataFrame) -> DataFrame:
    """points with __centres: centre and cost in place of it."""
    best = F.array_min(F.transform("__centres", lambda s: F.struct(squared_distance(F.col("v"), s["c"]).alias("d"), s["centre"].alias("centre"))))
    return points.withColumn("__m", best).select(*[c for c in points.columns if c != "__centres"], F.col("__m.centre").alias("centre"), F.col("__m.d").alias("cost"))


def _keys(centres: DataFrame) -> list[str]:
    return [c for c in centres.columns if c not in ("centre", "c")]


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """C4: points with centre and cost, the squared distance to it; ties to the least centre. centres(centre, c) has k rows, which
    every row meets where it is: nothing is shuffled, and repeated rows stay. Without centres both columns are null. Centres
    with further columns, such as a seed, are sets of centres: each point has a row for each set."""
    return _nearest(points.crossJoin(F.broadcast(_centre_list(centres, *_keys(centres)))))


def kmeans_cost(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One row (cost)."""
    return nearest_centre(points, centres).agg(F.sum("cost").alias("cost"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """sum(w x) / sum(w), 0 where the weights add up to nothing."""
    w = F.sum(weight)
    return df.groupBy(*by).agg(F.when(w != 0, F.sum(F.col(value) * F.col(weight)) / w).otherwise(0.0).alias("mean"))


def lloyd(points: DataFrame, centres: DataFrame, rounds: int, weight: str | None = None) -> DataFrame:
    """centres(centre, c) after so many rounds; an empty cluster returns to its first centre. Sets of centres move side by side."""
    start = now = centres
    w, by = F.col(weight) if weight else F.lit(1.0), [*_keys(centres), "centre"]
    for _ in range(rounds):
        a = nearest_centre(points, now).select(*by, w.alias("w"), F.posexplode("v").alias("dim", "x"))
        mean = weighted_mean(a, [*by, "dim"], "x", "w").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("m"))
        now = cut(start.join(mean, by, "left").select(*by, F.coalesce("m", "c").alias("c")), *([] if now is start else [now]))
    return now


def seeded(points: DataFrame, k: int, seeds: list[int]) -> DataFrame:
    """For every seed k centres(seed, centre, c), drawn in turn with probability in proportion to weight * squared distance to
    those before; all seeds draw in the same pass. points(id, v, w)."""
    key = lambda n, mass: F.struct((-F.log(1 - uniform(F.col("id"), F.col("seed"), n)) / mass).alias("k"), "id", "v")
    drawn = lambda df, n, mass: df.groupBy("seed").agg(F.min(key(n, mass)).alias("m")).select("seed", F.lit(n or 1).alias("centre"), F.col("m.v").alias("c"))
    each = points.where("w > 0").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    centres = cut(drawn(each, 0, F.col("w")))
    for n in range(2, k + 1):
        cost = nearest_centre(points, centres).where("cost * w > 0")
        centres = cut(centres.unionByName(drawn(cost, n, F.col("cost") * F.col("w"))), centres)
    return centres


def kmeans_pp(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """centres(centre, c) of one seed."""
    return seeded(points, k, [seed]).drop("seed")


def best_lloyd(points: DataFrame, k: int, rounds: int = 10, runs: int = 10, seed: int = 1) -> DataFrame:
    """The cheapest of several runs from C1 seeds, ties to the least seed; the runs share every pass."""
    ends = lloyd(points, seeded(points, k, list(range(seed, seed + runs))), rounds, "w")
    costs = nearest_centre(points, ends).groupBy("seed").agg(F.sum(F.col("cost") * F.col("w")).alias("cost"))
    best = costs.orderBy("cost", "seed").limit(1).select("seed")
    return cut(ends.join(F.broadcast(best), "seed").drop("seed"), ends)


#: Distances of a node that local search keeps; those that it makes at a time where there are more.
HELD, MADE = 1 << 23, 1 << 20


def _swap(x: np.ndarray, w: np.ndarray, starts: np.ndarray, k: int, swaps: int) -> np.ndarray:
    """Indices of k centres by single-swap local search: exchanges that save one per cent or more, until none is found.

    starts: a row of draws per run; a run begins with the points of its least draws."""
    n, sq, best = len(x), (x * x).sum(1), (np.inf, np.zeros(0, int))
    step = max(2, n if n * n <= HELD else MADE // n)

    def between(at) -> np.ndarray:
        """Squared distances of all points to those at."""
        d = 2 * x @ x[at].T
        np.subtract(sq[:, None] + sq[None, at], d, out=d)
        return np.maximum(d, 0, out=d)

    whole = between(slice(None)) if step >= n else None
    for draws in starts:
        own = np.argsort(draws, kind="stable")[:k].copy()
        to = between(own) if whole is None else whole[:, own]
        cost = float((to.min(1) * w).sum())
        for _ in range(swaps):
            save, costs = None, np.empty((len(own), n))
            near = [np.delete(to, out, 1).min(1) if len(own) > 1 else np.full(n, np.inf) for out in range(len(own))]
            for at in range(0, n, step):
                d = between(slice(at, at + step)) if whole is None else whole
                for out, rest in enumerate(near):
                    m = np.minimum(d, rest[:, None])
                    m *= w[:, None]
                    costs[out, at : at + step] = m.sum(0)
            for out, at in enumerate(costs.argmin(1).tolist()):
                if costs[out, at] < 0.99 * cost and (save is None or costs[out, at] < save[0]):
                    save = (float(costs[out, at]), out, at)
            if save is None:
                break
            cost, own[save[1]] = save[0], save[2]
            to[:, save[1]] = between([save[2]])[:, 0] if whole is None else whole[:, save[2]]
        if cost < best[0]:
            best = (cost, own)
    return best[1]


def single_swap(points: DataFrame, k: int, node: str = "node", seed: int = 1, runs: int = 3, swaps: int = 50) -> DataFrame:
    """(node, centre, c) by local search inside every node, whose points must fit one task. Its pairs are made in
    blocks, anew in each step, so time grows with the square of a node's points and memory with the points."""
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        own = _swap(np.stack(pdf["v"].to_numpy()), pdf["w"].to_numpy(), np.stack(pdf["u"].to_numpy()).T, k, swaps)
        return pd.DataFrame({"node": pdf["node"].iloc[0], "centre": np.arange(1, len(own) + 1), "c": [pdf["v"].iloc[i].tolist() for i in own]})

    draws = F.array(*[uniform(F.col("id"), seed + run, "swap") for run in range(runs)])
    return points.select(F.col(node).cast("int").alias("node"), "id", "v", "w", draws.alias("u")).groupBy("node").applyInPandas(search, "node int, centre int, c array<double>")


def _drawn(costed: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """t draws with replacement per node in proportion to cost * w, by inverting the running sum in the order of ids.

    Rows are dealt to ranges of (node, id); sums of the ranges tell where a draw falls, and inside a range draws and rows are
    merged in one sorted pass: a draw takes the last row that begins at or before it. Repeated rows draw apart.
    """
    parts = int(costed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    c = costed.withColumn("m", F.col("cost") * F.col("w")).where("m > 0")
    placed = cut(c.repartitionByRange(parts, "node", "id").withColumn("p", F.spark_partition_id()))
    order = Window.partitionBy("node").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.groupBy("node", "p").agg(F.sum("m").alias("m")).withColumn("hi", F.sum("m").over(order))
    ranges = cut(ranges.withColumns({"lo": F.col("hi") - F.col("m"), "all": F.sum("m").over(Window.partitionBy("node"))}))  # as many rows as ranges
    draws = budgets.where("t > 0").select("node", F.explode(F.sequence(F.lit(1), F.col("t").cast("int"))).alias("draw")).withColumn("u", uniform(F.col("node"), F.col("draw"), seed))
    at = draws.join(F.broadcast(ranges), "node").where("u * all >= lo and u * all < hi").select("node", "p", (F.col("u") * F.col("all")).alias("at"))
    inside = Window.partitionBy("node", "p").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct("id", "v", "w", "centre", "cost", F.monotonically_increasing_id().alias("nr")).alias("row")
    begins = placed.withColumn("upto", F.sum("m").over(inside)).join(F.broadcast(ranges.select("node", "p", "lo")), ["node", "p"]).select("node", "p", (F.col("lo") + F.col("upto") - F.col("m")).alias("at"), row)
    both = begins.unionByName(at, allowMissingColumns=True)
    # of what stands at one place rows come first; rounding may put a range's first row just above a draw at its beginning
    merged = Window.partitionBy("node", "p").orderBy("at", F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("node", "p").orderBy("at", F.col("row").isNull()).rowsBetween(0, Window.unboundedFollowing)
    owner = F.coalesce(F.last("row", True).over(merged), F.first("row", True).over(after))
    taken = both.withColumn("owner", owner).where(F.col("row").isNull()).groupBy("node", "owner").agg(F.count("*").alias("times"))
    return taken.select("node", *[F.col(f"owner.{c}").alias(c) for c in ("id", "v", "w", "centre", "cost")], "times")


def distributed_coreset(points: DataFrame, centres: DataFrame, t: int, seed: int = 1) -> DataFrame:
    """coreset(node, id, v, w, is_center). points(id, v, w, node); centres(node, centre, c) are each node's own.

    t draws are shared out by ceil(t * local cost / cost). A node with no more points than draws sends all of them, as they
    are. A draw weighs (cost / t) / (own cost + 1e-5 * mean cost); a centre weighs its cluster's mass less that of its draws,
    which can be below zero. With centres, the weights of a node add up to its mass.
    """
    costed = cut(_nearest(points.join(F.broadcast(_centre_list(centres, "node")), "node")).select("node", "id", "v", "w", "centre", "cost"))
    local = costed.groupBy("node").agg(F.sum(F.col("cost") * F.col("w")).alias("local"), F.count("*").alias("n"), F.sum("w").alias("mass"))
    total = local.agg(F.sum("local").alias("total"), (F.sum("local") / F.sum("n")).alias("mean"))
    budgets = cut(local.crossJoin(F.broadcast(total)).withColumn("t", F.when(F.col("total") > 0, F.ceil(F.col("local") / F.col("total") * t)).otherwise(0)))
    whole = costed.join(budgets.where("n <= t").select("node"), "node", "left_semi").select("node", "id", "v", "w", F.lit(False).alias("is_center"))
    rest = costed.join(budgets.where("n > t").select("node"), "node", "left_semi")
    w = F.col("times") * F.col("total") / t / (F.col("cost") + 1e-5 * F.col("mean"))
    drawn = _drawn(rest, budgets.where("n > t"), seed).join(budgets.select("node", "total", "mean"), "node").withColumn("dw", w)
    taken = drawn.groupBy("node", "centre").agg(F.sum("dw").alias("taken"))
    mass = rest.groupBy("node", "centre").agg(F.sum("w").alias("mass")).join(taken, ["node", "centre"], "left").join(centres, ["node", "centre"])
    centre_rows = mass.select("node", F.col("centre").cast("long").alias("id"), F.col("c").alias("v"), (F.col("mass") - F.coalesce("taken", F.lit(0.0))).alias("w"), F.lit(True).alias("is_center"))
    return whole.unionByName(drawn.select("node", "id", "v", F.col("dw").alias("w"), F.lit(False).alias("is_center"))).unionByName(centre_rows)


def combined_coreset(points: DataFrame, centres: DataFrame, t: int, nodes: int, seed: int = 1) -> DataFrame:
    """Each node draws floor(t / nodes) on its own account, and the results are united."""
    parts = None
    for n in range(1, nodes + 1):
        own = distributed_coreset(points.where(F.col("node") == n), centres.where(F.col("node") == n), t // nodes, seed)
        parts = own if parts is None else parts.unionByName(own)
    return parts


def coreset(points: DataFrame, centres: DataFrame, t: int, seed: int = 1) -> DataFrame:
    """Of one data set, with centres(centre, c)."""
    return distributed_coreset(points.withColumn("node", F.lit(1)), centres.withColumn("node", F.lit(1)), t, seed)


def merged_on_tree(points: DataFrame, tree: DataFrame, root: int, k: int, t: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Coresets merged up a tree(parent, child) of nodes, one level at a time; returns the root's coreset and (sent) points."""
    edges = [(r["parent"], r["child"]) for r in tree.collect()]  # a network of few nodes
    depth, level = {root: 0}, [root]
    while level:
        level = [c for p, c in edges if p in level]
        depth |= {c: max(depth.values()) + 1 for c in level}
    spark, now, sent = points.sparkSession, points.select("id", "v", "w", "node"), 0
    for d in range(max(depth.values()), -1, -1):
        at = [n for n, x in depth.items() if x == d]
        here = cut(now.where(F.col("node").isin(at)).where("w > 0"))
        c = single_swap(here, k, seed=seed, runs=1, swaps=10)
        made = distributed_coreset(here, cut(c), t, seed).select(F.col("id"), "v", "w", "node")
        if d:
            up = spark.createDataFrame([(c, p) for p, c in edges], "node int, up int")
            made = cut(made.join(up, "node").select(F.xxhash64("node", "id", F.lit(d)).alias("id"), "v", "w", F.col("up").alias("node")))
            sent += made.count()
            now = made.unionByName(now.where(~F.col("node").isin(at)))
        else:
            now = made
    return now, spark.createDataFrame([(sent,)], "sent long")
