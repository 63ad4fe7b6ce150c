"""SimHash near-duplicates at a given Jaccard similarity of word shingles.

Two texts are linked if their sets of XXH64 shingle hashes have a Jaccard similarity of LEAST or more. A set has a SimHash
fingerprint, and 64 bits say too little to find all such pairs by blocks that agree (at 0.8 ten bits differ on average), so
the groups in which fingerprints meet are those of BANDS bands of ROWS min-hashes: a pair at similarity j is in no common
group with probability (1 - j^ROWS)^BANDS, 5 in 100,000 at 0.8 and less above. Inside a group, pivot distance tables discard
pairs whose fingerprints differ in over LIMIT bits (of pairs at 0.8 fewer than one in a million do), and what is left is
verified on the sets. Equal sets are one node.

Large groups do not compare all pairs at once: in a round each set meets one centre, the same one for all sets that share a
group with it, and only what these links leave apart meets pairwise, so a large group of copies costs about its size. Where
all pairs meet, sets go to their groups and links leave them; pairs that are not similar are never rows. Of the texts only
those move that share a group or may be lost.

Null and wordless texts have the empty set, which equals itself; fewer words than a shingle make one shingle; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, small_batches, text_or_empty
from .components import components
from .simhash import GROUP, _Forest, fingerprint, pairs_between, shingle_hashes

#: Similarity as a fraction, compared in whole numbers.
LEAST = (4, 5)
BANDS, ROWS, SEED = 25, 5, 17
#: Pairs whose ids are broadcast (16 bytes a pair).
FEW = 200_000
#: Bits in which the 64-bit fingerprints of similar sets may differ.
LIMIT = 24
#: Pairs per member of a group that are verified without rounds of centres; rounds before all pairs are verified at any number.
FULL, ROUNDS = 4, 8
#: Centres go on while a round leaves no more than this share of the pairs that it found open.
HELPS = 0.8
#: Words of 64 bits in a map of hashes.
WORDS = 1 << 18
#: Hashes that meet the multipliers at a time.
CHUNK = 256


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)


def bands(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A 64-bit key per band from the distinct hashes of a text."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), CHUNK):
        np.minimum(least, (low[at : at + CHUNK, None] * odd).min(0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for m in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ m) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _signatures(words: int):
    def run(batches):
        odd = _multipliers()
        for batch in batches:
            s, n, f, keys = [], [], [], []
            for t in batch.column("t"):
                own = np.unique(shingle_hashes(t.as_buffer().to_pybytes(), words))
                s.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                n.append(len(own))
                f.append(fingerprint(own))
                keys.append(bands(own, odd).tolist() if len(own) else [])
            cols = [*batch.columns[:-1], pa.array(np.array(s, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(np.array(f, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "s", "n", "f", "keys"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            own = [np.unique(shingle_hashes(t.as_buffer().to_pybytes(), words)).tobytes() for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(own, pa.binary())], names=["s", "x"])

    return run


def _alike(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether sorted sets have a similarity of LEAST or more."""
    p, q = LEAST
    both = np.concatenate([u, v])
    both.sort(kind="stable")  # two sorted runs
    shared = int((both[1:] == both[:-1]).sum())
    return q * shared >= p * (len(both) - shared)


def _similar(batches):
    for batch in batches:
        keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets(s, x) are similar. Up to FEW pairs, their ids go to where the sets are, and only these sets move."""
    if pairs.count() <= FEW:
        ids = pairs.select(F.col("a").alias("s")).unionAll(pairs.select(F.col("b").alias("s"))).distinct()
        sets = sets.join(F.broadcast(ids), "s", "left_semi")
    j = pairs.join(sets.select(F.col("s").alias("a"), "x"), "a").join(sets.select(F.col("s").alias("b"), F.col("x").alias("y")), "b")
    return j.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long")


def _to_centres(at: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set with one centre of its groups that may be similar to it: the first in an order of all sets that changes by turn."""
    p, q = LEAST
    centre = at.groupBy("g").agg(F.min(F.struct(F.xxhash64("s", F.lit(turn)).alias("o"), "s", "n", "f", "c")).alias("m"))
    j = at.join(centre, "g").where("c <> m.c").where(F.least("n", "m.n") * q >= F.greatest("n", "m.n") * p)
    near = j.where(F.bit_count(F.col("f").bitwiseXOR(F.col("m.f"))) <= LIMIT)
    first = near.groupBy("s").agg(F.min(F.struct("m.o", "m.s")).alias("m")).select("s", F.col("m.s").alias("t"))
    return first.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _common(p: set[int], q: set[int]) -> int:
    return min(p & q)


def _of_group(held, g0: int) -> tuple[list[int], list[int]]:
    """Links (a, b) of a group, or of a tile of a large one, between sets that are similar and not yet of one component.

    Sets that share further groups meet in the least of them alone."""
    s, n, f, c, side, x, gs = (np.concatenate(h) for h in zip(*held))
    p, q = LEAST
    forest, at = _Forest(len(np.unique(c))), np.unique(c, return_inverse=True)[1].tolist()
    u, v = (np.flatnonzero(side != 2), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(s)), np.arange(len(s)))
    own, of = [np.frombuffer(b, np.uint64) for b in x], [set(g.tolist()) for g in gs]
    a, b = [], []
    for i, j in pairs_between(f[u], f[v], LIMIT):
        i, j = u[i], v[j]
        ok = (c[i] != c[j]) & (np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p)
        ok &= side.any() | (i < j)
        for k, m in zip(i[ok].tolist(), j[ok].tolist()):
            if forest.root(at[k]) != forest.root(at[m]) and _common(of[k], of[m]) == g0 and _alike(own[k], own[m]):
                forest.join(at[k], at[m])
                a.append(int(min(s[k], s[m])))
                b.append(int(max(s[k], s[m])))
    return a, b


def _by_pivots(frames):
    """Frames hold whole groups one after another: rows are sorted by group within a partition."""
    import pandas as pd

    key, first, held = None, None, []

    def out():
        a, b = _of_group(held, first) if sum(len(h[0]) for h in held) > 1 else ([], [])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    for pdf in frames:
        if not len(pdf):
            continue
        g = pdf["g"].to_numpy()
        begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        columns = [pdf[k].to_numpy() for k in ("s", "n", "f", "c", "side", "x", "gs")]
        columns[2] = columns[2].view(np.uint64)
        for u, v in zip(begin.tolist(), [*begin[1:].tolist(), len(g)]):
            if held and g[u] != key:
                yield out()
                held = []
            key, first = g[u], int(pdf["g0"].iloc[u])
            held.append([k[u:v] for k in columns])
    if held:
        yield out()


def _in_groups(named: DataFrame, per: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the similar pairs of all members of the groups per(g). A set goes to its groups, so no pair is a row before it is
    verified; groups over GROUP rows are tiled over many tasks."""
    at = cut(named.select(F.explode("gs").alias("g"), "s").join(per.select("g"), "g", "left_semi"))
    own = named.select("s", "n", "f", "c").join(at.groupBy("s").agg(F.collect_list("g").alias("gs")), "s").join(sets, "s")
    hot = cut(at.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > GROUP).select("g", F.ceil(F.col("k") / (GROUP // 2)).cast("int").alias("tiles")))
    row = ["s", "n", "f", "c", "x", "gs"]
    j = own.select(F.explode("gs").alias("g0"), *row).join(F.broadcast(hot.withColumnRenamed("g", "g0")), "g0", "left")  # as many as members by GROUP at most
    part = F.pmod(F.xxhash64("s"), F.col("tiles")).cast("int")
    plain = j.where("tiles is null").select(F.col("g0").alias("g"), "g0", *row, F.lit(0).alias("side"))
    # tile (t, u), t <= u: rows of part t meet those of part u; each part goes to all its tiles
    t = j.where("tiles is not null").withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = t.select(F.xxhash64("g0", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "g0", *row, F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    dealt = plain if not hot.count() else plain.unionAll(tiled)
    return dealt.repartition("g").sortWithinPartitions("g", "g0").mapInPandas(_by_pivots, "a long, b long").distinct()


def links(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """members(g, s, n, f) of groups: (id, component) of all sets that are linked inside groups; None without groups."""
    size = members.count()
    if not size:
        return None
    own = cut(members.groupBy("s", "n", "f").agg(F.collect_list("g").alias("gs")))
    found = tested = parts = before = None
    for turn in range(ROUNDS + 1):
        named = own.withColumn("c", F.col("s")) if parts is None else own.join(parts.select(F.col("id").alias("s"), F.col("component").alias("c0")), "s", "left").select("s", "n", "f", "gs", F.coalesce("c0", "s").alias("c"))
        named = cut(named)
        at = named.select(F.explode("gs").alias("g"), "s", "n", "f", "c")
        per = cut(at.groupBy("g", "c").agg(F.count("*").cast("double").alias("k")).groupBy("g").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("open")).where("open > 0"))
        left = per.agg(F.sum("open")).first()[0]
        if not left:
            break
        # all that is left meets when it is little, and when centres no longer make it less
        whole = left <= FULL * size or turn == ROUNDS or before is not None and left > HELPS * before
        before = left
        if whole:
            new = cut(_in_groups(named, per, sets))
        else:
            pairs = _to_centres(at, turn)
            pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
            new = cut(verified(pairs, sets))
            tested = pairs if tested is None else tested.unionAll(pairs)
        found = new if found is None else found.unionAll(new)
        parts = components(found)
        if whole:
            break
    return parts


def maybe_among(df: DataFrame, key, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among hashes(h), those whose key is not), by a map of bits of fixed size that is broadcast."""
    w, b, m = (free_name(df, f"__{k}") for k in "wbm")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int"))
    word = lambda h: F.pmod(h, F.lit(WORDS)).cast("int")
    bits = cut(hashes.select(word(F.col("h")).alias(w), bit(F.col("h")).alias(m)).groupBy(w).agg(F.bit_or(m).alias(m)))
    held = df.withColumns({w: word(key), b: bit(key)}).join(F.broadcast(bits), w, "left")
    hit = F.coalesce(F.col(m).bitwiseAND(F.col(b)), F.lit(0)) != 0
    return held.where(hit).select(*df.columns), held.where(~hit).select(*df.columns)


def one_of_each(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row per component of near-duplicates: the first by (doc_id, hash of the text), rows without id last."""
    small_batches(docs.sparkSession, 500)
    body = text_or_empty(text).cast("binary")
    key = F.xxhash64(body)
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("h"), body.alias("t")).mapInArrow(_signatures(words), "doc_id long, h long, s long, n long, f long, keys array<long>"))
    dealt = rows.dropDuplicates(["s"]).select(F.explode("keys").alias("g"), "s", "n", "f")
    # groups of the same members, as most bands of near copies make, are one
    of = dealt.groupBy("g").agg(F.count("*").alias("k"), *[F.expr(f"bit_xor(xxhash64(s, {i}))").alias(f"x{i}") for i in (1, 2)]).where("k > 1")
    shared = of.groupBy("k", "x1", "x2").agg(F.min("g").alias("g")).select("g")
    members = cut(dealt.join(shared, "g"))
    some = members.select("s").distinct().join(rows.groupBy("s").agg(F.min("h").alias("h")), "s")
    few, _ = maybe_among(docs.select(key.alias("h"), body.alias("t")), F.col("h"), some.select("h"))
    sets = cut(few.join(some, "h").dropDuplicates(["s"]).select("s", "t").mapInArrow(_sets(words), "s long, x binary"))
    parts = links(members, sets)
    if parts is None:
        named = rows.withColumn("c", F.col("s"))
    else:
        named = rows.join(parts.select(F.col("id").alias("s"), F.col("component").alias("c0")), "s", "left").withColumn("c", F.coalesce("c0", "s"))
    last = F.col("doc_id").isNull()
    keep = cut(named.groupBy("c").agg(F.min(F.struct(last.alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")).alias("m")).select("m.*"))
    names = [free_name(docs, f"__{k}") for k in ("last", "id", "h")]
    # only rows that may be lost move: those that are not kept, and those of one id and text
    per = named.groupBy(last.alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h").agg(F.count("*").alias("k"))
    lost = per.join(keep.withColumn("kept", F.lit(True)), ["last", "id", "h"], "left").where("kept is null or k > 1")
    own = docs.withColumns(dict(zip(names, (F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), key))))
    doubtful, sure = maybe_among(own, F.xxhash64(*names), lost.select(F.xxhash64("last", "id", "h").alias("h")))
    some = doubtful.dropDuplicates(names).join(keep.toDF(*names), names, "left_semi")
    return sure.unionByName(some).select(*docs.columns)
