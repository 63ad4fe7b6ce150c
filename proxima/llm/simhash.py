"""SimHash near-duplicates with pivot distance tables.

Fingerprints: one 64-bit majority vote per text over the XXH64 of its word shingles. Links: distinct fingerprints are
dealt to groups in which two blocks agree (two of LIMIT + 2 blocks must, if at most LIMIT bits differ). Inside a group a
table of Hamming distances to PIVOTS fixed reference fingerprints is made; sorted by the first pivot, only rows within
LIMIT of each other meet, pairs with a coordinate difference over LIMIT are discarded, the rest are verified by XOR. A
group emits the links of a spanning forest, never all its pairs, and groups over GROUP rows are tiled over many tasks.
Components come from iterated joins whose state is in the shared folder.

Null and wordless texts have the fingerprint zero, which links like any other; fewer words than a shingle make one
shingle; equal fingerprints are one node; a null doc_id is kept and never names a component (a component of null ids only
is null); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, small_batches, text_or_empty
from .components import components

SEED, LIMIT, WORDS = 42, 4, 4
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Reference fingerprints: pseudo-random, the same everywhere.
PIVOTS = 24
#: Rows of a group that one task compares at a time; larger groups are tiled.
GROUP = 4096
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 15


def shingle_hashes(data: bytes, words: int = WORDS) -> np.ndarray:
    """The XXH64 of every shingle of the text (bytes, lower-cased here), repeats included."""
    w = data.translate(LOWER).split()  # bytes split at ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(b" ".join(w), SEED)], np.uint64)
    # one joined text and the places of its words: a shingle is a slice
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        own = np.ascontiguousarray(hashes[at : at + CHUNK].astype(">u8")).view(np.uint8).reshape(-1, 8)
        set_ += _bit_counts(own)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes)).tobytes(), "big")


#: Per byte value, its bits as eight 8-bit fields of one 64-bit number: up to 255 of them add up without carrying.
_SPREAD = np.array([sum(((v >> (7 - b)) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    spread = _SPREAD[rows]  # n x 8
    n = len(spread)
    whole = n // 255 * 255
    out = np.zeros((8, 8), np.int64)
    if whole:
        s = spread[:whole].reshape(-1, 255, 8).sum(1)
        out += np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8, 8).sum(0, dtype=np.int64)
    if n > whole:
        s = np.ascontiguousarray(spread[whole:].sum(0))
        out += s.view(np.uint8).reshape(8, 8)
    return out.reshape(64)


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t.as_buffer().to_pybytes(), words)) for t in batch.column("text")]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""
    small_batches(docs.sparkSession, 500)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("string").alias("text")).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _blocks(limit: int) -> list[tuple[int, int]]:
    """(shift, mask) of limit + 2 blocks of the 64 bits."""
    edges = [64 * i // (limit + 2) for i in range(limit + 3)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def pivots() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 2**64, PIVOTS, np.uint64)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pairs_between(x: np.ndarray, y: np.ndarray, limit: int):
    """Yields index arrays (i, j) with Hamming distance <= limit between x and y, by pivot tables."""
    p = pivots()
    tx = np.bitwise_count(x[:, None] ^ p).astype(np.int8)
    ty = np.bitwise_count(y[:, None] ^ p).astype(np.int8)
    order = np.argsort(ty[:, 0], kind="stable")
    y, ty = y[order], ty[order]
    low = np.searchsorted(ty[:, 0], tx[:, 0] - limit, "left")
    high = np.searchsorted(ty[:, 0], tx[:, 0] + limit, "right")
    step = max(1, 2_000_000 // max(1, len(y)))
    for at in range(0, len(x), step):
        n = high[at : at + step] - low[at : at + step]
        i = np.repeat(np.arange(at, at + len(n)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at : at + step], n)
        for k in range(1, PIVOTS):  # each coordinate discards about four in ten of unrelated pairs
            if not len(i):
                break
            near = np.abs(tx[i, k] - ty[j, k]) <= limit
            i, j = i[near], j[near]
            if k % 4 == 3 and len(i) < 64:
                break
        true = np.bitwise_count(x[i] ^ y[j]) <= limit
        yield i[true], order[j[true]]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest_links(x: np.ndarray, y: np.ndarray | None, limit: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs inside x, or between x and y."""
    both = x if y is None else np.concatenate([x, y])
    forest, out = _Forest(len(both)), []
    for i, j in pairs_between(x, x if y is None else y, limit):
        j = j if y is None else j + len(x)
        for a, b in zip(i.tolist(), j.tolist()):
            if a < b and forest.join(a, b):
                out.append((int(both[a]), int(both[b])))
    return out


LINKS = "a long, b long"


def _linked(limit: int):
    def run(frames):
        """Frames hold whole groups one after another: rows are sorted by group within a partition."""
        key, held, out = None, [], []
        for pdf in frames:
            if not len(pdf):
                continue
            fps, gs, sides = pdf["fp"].to_numpy().view(np.uint64), pdf["g"].to_numpy(), pdf["side"].to_numpy()
            begin = np.flatnonzero(np.r_[True, gs[1:] != gs[:-1]])
            end = np.r_[begin[1:], len(pdf)]
            some = end - begin > 1  # a row alone in its group meets nobody, unless the group goes on in another frame
            some[[0, -1]] = True
            for a, b in zip(begin[some].tolist(), end[some].tolist()):
                if gs[a] != key:
                    out += _of_group(held, limit)
                    key, held = gs[a], []
                held.append((fps[a:b], sides[a:b]))
            if len(out) > 50_000:
                yield _frame(out)
                out = []
        yield _frame(out + _of_group(held, limit))

    return run


def _frame(links) -> pd.DataFrame:
    a = np.array([x for x, _ in links], np.uint64).view(np.int64)
    b = np.array([x for _, x in links], np.uint64).view(np.int64)
    return pd.DataFrame({"a": a, "b": b})


def _of_group(held, limit):
    if not held:
        return []
    x, side = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    if len(x) < 2:
        return []
    if (side == 0).all():
        return _forest_links(x, None, limit)
    return _forest_links(x[side == 1], x[side == 2], limit)


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """distinct(fp): links (a, b) that connect every two fingerprints which differ in at most limit bits, perhaps over others."""
    spark = distinct.sparkSession
    blocks = _blocks(limit)
    keys = [F.xxhash64(F.lit(k), F.shiftrightunsigned("fp", blocks[i][0]).bitwiseAND(F.lit(_signed(blocks[i][1]))), F.shiftrightunsigned("fp", blocks[j][0]).bitwiseAND(F.lit(_signed(blocks[j][1])))) for k, (i, j) in enumerate(combinations(range(len(blocks)), 2))]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("g"))
    sizes = cut(dealt.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))
    hot = sizes.select("g", F.ceil(F.col("n") / (GROUP // 2)).cast("int").alias("tiles"))
    n_hot = hot.count()
    # in sorted partitions, without a row per group; lone fingerprints cost a comparison of keys only
    if not n_hot:
        plain = dealt.select("g", "fp", F.lit(0).alias("side"))
        tiled = None
    else:
        j = dealt.join(hot, "g", "left")
        plain = j.where("tiles is null").select("g", "fp", F.lit(0).alias("side"))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        # tile (s, t), s <= t: rows of part s meet those of part t; each part goes to all its tiles
        t = j.where("tiles is not null").withColumn("own", own).select("g", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        tiled = t.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    rows = plain if tiled is None else plain.unionAll(tiled)
    return rows.repartition("g").sortWithinPartitions("g").mapInPandas(_linked(limit), LINKS)


def near_duplicates(docs: DataFrame, limit: int = LIMIT, words: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable over links)."""
    prints = cut(fingerprints(docs, text, doc_id, words))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(links(groups.select("fp"), limit)).withColumnRenamed("id", "fp")
    ids = groups.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    # ids are written so that the join with documents, where one fingerprint may be frequent, can be split
    ids = cut(ids.join(named, "component").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, limit: int = LIMIT, words: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row per component: that with the smallest doc_id (of rows that repeat it, one; rows without id stay)."""
    keep, n = free_name(docs, "keep"), free_name(docs, "nr")
    found = near_duplicates(docs, limit, words, text, doc_id).where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    at = F.row_number().over(Window.partitionBy(doc_id).orderBy(*[F.xxhash64(F.col(f"`{c}`")) for c in docs.columns]))
    once = docs.where(F.col(doc_id).isNotNull()).join(found, F.col(doc_id).cast("long") == F.col(keep), "left_semi")
    once = once.withColumn(n, at).where(F.col(n) == 1).drop(n)
    return once.unionByName(docs.where(F.col(doc_id).isNull()))
