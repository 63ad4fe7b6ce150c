"""Exact inner-product top-k by ball trees.

Every shard of vectors gets a ball tree; query blocks descend it by branch and bound. A node's bound is q.c + |q| r; at a
fork each query takes the child with the larger bound first, and no query enters a node whose bound is below its current
kth score. That score is shared: it begins at the exact kth score over a first bounded slice of the table and passes from
shard to shard within a task; shards return only what reaches it.

A component x becomes floor(256 * x). Vectors that are null, empty of values, or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; rows with the query's own id are no candidates for it; repeated rows are
candidates like any others, and an id that occurs twice among the queries asks once. Scores beyond 64 bits stop at the ends of that range. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches

#: Vectors of a shard, of a leaf, of a query block; blocks that are broadcast at a time (so their bytes have a bound).
SHARD, LEAF, BLOCK, BLOCKS = 4096, 128, 512, 64
#: Rows of the slice that gives the first kth scores.
FIRST = 4096
INT = np.iinfo(np.int64)


class BallTree:
    """Nodes over integer vectors held as float64 (exact below 2**53)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.ids, self.points, self.leaf = ids, points, leaf
        self.exact = float(np.abs(points).max(initial=0)) < 2**23  # products of such vectors add up exactly
        self.root = self._node(np.arange(len(ids)))

    def _node(self, rows: np.ndarray):
        own = self.points[rows]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-6
        if len(rows) <= self.leaf:
            return centre, radius, rows, None, None
        far = own[((own - centre) ** 2).sum(1).argmax()]
        other = own[((own - far) ** 2).sum(1).argmax()]
        along = own @ (other - far)
        order = np.argsort(along, kind="stable")  # halves by rank: equal points still split
        half = len(rows) // 2
        return centre, radius, None, self._node(rows[order[:half]]), self._node(rows[order[half:]])

    def search(self, qids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int, keep) -> None:
        """Offers candidates to keep(query positions, ids, scores); kth is read anew at each node."""
        norms = np.sqrt((queries**2).sum(1))
        self._down(self.root, np.arange(len(qids)), qids, queries, norms, kth, k, keep)

    def _bound(self, node, queries, norms):
        b = queries @ node[0] + norms * node[1]
        return b + np.abs(b) * 1e-9 + 1e-3

    def _down(self, node, who, qids, queries, norms, kth, k, keep):
        who = who[self._bound(node, queries[who], norms[who]) >= kth[who]]
        if not len(who):
            return
        rows = node[2]
        if rows is not None:
            keep(who, self.ids[rows], self._scores(queries[who], self.points[rows]))
            return
        left, right = (self._bound(x, queries[who], norms[who]) for x in node[3:5])
        first = left >= right
        for part, order in ((who[first], (3, 4)), (who[~first], (4, 3))):
            for child in order:
                if len(part):
                    self._down(node[child], part, qids, queries, norms, kth, k, keep)

    def _scores(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        if self.exact and float(np.abs(q).max(initial=0)) < 2**23:
            return (q @ p.T).astype(np.int64)
        exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in p], object).T
        return np.clip(exact, INT.min, INT.max).astype(np.int64)


class Best:
    """Per query, the k best (score, id) so far; floor: kth scores known from elsewhere."""

    def __init__(self, qids: np.ndarray, k: int, floor: np.ndarray):
        self.qids, self.k, self.kth, self.found = qids, k, floor.astype(np.float64), [[] for _ in qids]

    def keep(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.kth[who][:, None]) & (ids[None, :] != self.qids[who][:, None])
        for j in np.flatnonzero(hit.any(1)):
            w, at = who[j], np.flatnonzero(hit[j])
            self.found[w] = sorted([*self.found[w], *zip((-scores[j, at]).tolist(), ids[at].tolist())])[: self.k]
            if len(self.found[w]) == self.k:
                self.kth[w] = max(self.kth[w], -self.found[w][-1][0])

    def frame(self) -> pd.DataFrame:
        rows = [(q, i, -s) for q, own in zip(self.qids.tolist(), self.found) for s, i in own]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def _matrix(vectors: pd.Series) -> np.ndarray:
    lengths = {len(v) for v in vectors}
    if len(lengths) <= 1:
        return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    out = np.zeros((len(vectors), max(lengths)))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _searched(blocks: list, k: int):
    """blocks: [(ids, matrix, kth)]; a task keeps its kth scores from shard to shard and returns what it found at its end."""

    def run(batches):
        best, seen = [Best(q, k, floor) for q, _, floor in blocks], False

        def against(frames):
            if not frames:
                return
            pdf = pd.concat(frames, ignore_index=True)
            pts = _matrix(pdf["q"])
            width = max([pts.shape[1], *(m.shape[1] for _, m, _ in blocks)])
            tree = BallTree(pdf["vec_id"].to_numpy(np.int64), _padded(pts, width))
            for (q, m, _), b in zip(blocks, best):
                tree.search(q, _padded(m, width), b.kth, k, b.keep)

        held, n = [], 0
        for pdf in batches:
            held, n, seen = [*held, pdf], n + len(pdf), True
            if n >= SHARD:
                against(held)
                held, n = [], 0
        against(held)
        for b in best if seen else []:
            yield b.frame()

    return run


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q): the rows that take part, with integer components as doubles."""
    e = F.col("e")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~bad).select("vec_id", F.transform(e, lambda x: F.floor(x * 256).cast("double")).alias("q"))


def _floored(first, k: int):
    """The queries with kth, their kth score over the first slice, which is one tree."""

    def run(frames):
        tree, width = None, 1
        for pdf in frames:
            if not len(pdf):
                continue
            m = _matrix(pdf["q"])
            kth = np.full(len(m), -np.inf)
            if first.value:
                ids, points = first.value
                if tree is None or m.shape[1] > width:
                    width = max(points.shape[1], m.shape[1])
                    tree = BallTree(ids, _padded(points, width))
                best = Best(pdf["vec_id"].to_numpy(np.int64), k, kth)
                tree.search(best.qids, _padded(m, width), best.kth, k, best.keep)
                kth = best.kth
            yield pdf.assign(kth=kth)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors(vec_id, q) searched for each of queries(vec_id, q): (query_id, rank, vec_id, score), ties to the smaller id.

    An id asks once: of queries that repeat it, the one with the least hash. Queries go out BLOCKS blocks at a time, which bounds
    what is broadcast; each such round writes what it found to the shared folder, and its broadcast goes."""
    spark = vectors.sparkSession
    small_batches(spark, 1024)
    one = queries.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("q").alias("h"), "q")).alias("m")).select("vec_id", "m.q")
    every = max(1, vectors.count() // FIRST)  # about FIRST rows by hash; the limit bounds ids that repeat
    first = spark.sparkContext.broadcast(_block(vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(2 * FIRST).collect()))
    qs = cut(one.mapInPandas(_floored(first, k), "vec_id long, q array<double>, kth double"))
    at, found = scratch(spark, "topk"), "query_id long, vec_id long, score long"
    spark.createDataFrame([], found).write.parquet(at)
    for blocks in _chunks(qs):
        sent = spark.sparkContext.broadcast(blocks)
        vectors.select("vec_id", "q").mapInPandas(lambda it, sent=sent: _searched(sent.value, k)(it), found).write.mode("append").parquet(at)
        sent.destroy()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spark.read.schema(found).parquet(at).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(rows: list) -> tuple[np.ndarray, np.ndarray] | None:
    return (np.array([r["vec_id"] for r in rows], np.int64), _matrix(pd.Series([r["q"] for r in rows]))) if rows else None


def _chunks(queries: DataFrame):
    """The queries, BLOCKS blocks at a time: the driver holds one such chunk, of a bounded number of rows."""
    held, blocks = [], []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            blocks.append((*_block(held), np.array([r["kth"] for r in held])))
            held = []
            if len(blocks) == BLOCKS:
                yield blocks
                blocks = []
    if held:
        blocks.append((*_block(held), np.array([r["kth"] for r in held])))
    if blocks:
        yield blocks
