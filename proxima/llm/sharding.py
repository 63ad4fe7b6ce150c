"""Sharding with sampled splitters.

Keys are (xxhash64 of the text, doc_id), so equal texts are neighbours. A size-weighted sample of keys gives quantile
boundaries, rows are range-partitioned by them, and every range that is overfull, or that holds a border between shards
and is not yet fine enough, is sampled again and subdivided. Boundaries fall between texts; only a text whose copies
overfill a range is divided by doc_id. The ranges, in key order, are then dealt to the shards at the exact byte counts.

Null texts count as empty (size 1); null ids sort first. Repeated rows are rows like any others. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

LOW = -(2**63)
#: Splitters of one round of sampling, and rounds at most.
RANGES, ROUNDS = 1024, 6
#: The prefixes of the hash (12 bits) by which a row finds its few splitters.
PREFIXES = 4096


def _range_of(keys: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """keys(h, id, ...) with rng: the number of splitters that are at or before the row's key.

    The splitters go out by prefix of h, in a table of PREFIXES rows: its size has a bound that no input changes.
    """
    spark = keys.sparkSession
    by: list[list[tuple[int, int]]] = [[] for _ in range(PREFIXES)]
    for h, i in splitters:
        by[(h >> 52) + PREFIXES // 2].append((h, i))
    rows, before = [], 0
    for p, own in enumerate(by):
        rows.append((p - PREFIXES // 2, before, own))
        before += len(own)
    small = spark.createDataFrame(rows, "pre long, base long, own array<struct<sh:long,si:long>>")
    inside = F.size(F.filter("own", lambda s: (s["sh"] < F.col("h")) | ((s["sh"] == F.col("h")) & (s["si"] <= F.col("id")))))
    return keys.withColumn("pre", F.shiftright("h", 52)).join(F.broadcast(small), "pre").withColumn("rng", F.col("base") + inside).drop("pre", "base", "own")


def _sample(keys: DataFrame, per_row: Column, seed: int) -> list:
    """A size-weighted sample: a row comes with probability size * per_row, at most 1; its weight keeps totals unbiased."""
    u = (F.shiftrightunsigned(F.xxhash64("h", "id", F.lit(seed)), 11).cast("double")) / float(2**53)
    p = F.least(F.lit(1.0), F.col("size") * per_row)
    return keys.where(u < p).select("rng", "h", "id", (F.col("size") / p).alias("w")).collect()


def _quantiles(sample: list, ranges: int) -> list[tuple[int, int]]:
    """Up to `ranges` boundaries at equal steps of weight; a text that fills steps of its own is divided by id."""
    sample = sorted(sample, key=lambda r: (r["h"], r["id"]))
    step = sum(r["w"] for r in sample) / max(1, ranges)
    of_text: dict[int, float] = {}
    for r in sample:
        of_text[r["h"]] = of_text.get(r["h"], 0) + r["w"]
    out, sofar, nxt = set(), 0.0, step
    for r in sample:
        if sofar >= nxt:
            out.add((r["h"], r["id"] if of_text[r["h"]] > 2 * step and (r["h"], LOW) in out else LOW))
            nxt = sofar + step
        elif of_text[r["h"]] > 2 * step and (r["h"], LOW) not in out:
            out.add((r["h"], LOW))  # the text begins a range of its own
        sofar += r["w"]
    return sorted(out)


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> tuple[list[tuple[int, int]], list]:
    """Boundaries over keys(h, id, size), and rows (rng, bytes, n) of the ranges between them."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = _quantiles(_sample(keys.withColumn("rng", F.lit(0)), F.lit(8.0 * RANGES / max(1, total)), 1), RANGES)
    fine = tolerance * total / shards
    for round_ in range(2, ROUNDS + 2):
        sized = _range_of(keys, cuts)
        ranges = sized.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(F.struct("h", "id")).alias("first"), F.max(F.struct("h", "id")).alias("last")).orderBy("rng").collect()
        over, sofar = {}, 0
        for r in ranges:
            borders = [k for k in range(1, shards) if sofar < k * total / shards < sofar + r["bytes"]]
            if r["first"] != r["last"] and (r["bytes"] > 4 * total / RANGES or borders and r["bytes"] > fine):
                over[r["rng"]] = r["bytes"]
            sofar += r["bytes"]
        if not over or round_ > ROUNDS:
            return cuts, ranges
        rate = F.element_at(F.create_map(*[F.lit(x) for k, v in over.items() for x in (k, 512.0 / v)]), F.col("rng"))
        found: dict[int, list] = {}
        for r in _sample(sized.where(F.col("rng").isin(list(over))), rate, round_):
            found.setdefault(r["rng"], []).append(r)
        more = {c for own in found.values() for c in _quantiles(own, 64)}
        if more <= set(cuts):  # one text is left between two boundaries: divide it by id
            more = {(r["h"], r["id"]) for own in found.values() for r in sorted(own, key=lambda r: (r["h"], r["id"]))[:: max(1, len(own) // 64)]}
        cuts = sorted(set(cuts) | more)
    return cuts, ranges


def shard(df: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.001) -> DataFrame:
    """df with size, text_crc32, shard and slot: the shards' bytes differ by the tolerance or by one row or small text group.

    Columns of df that have these names are replaced. Shards are contiguous in (hash of text, id); slots are gapless from 0.
    """
    df = df.drop("size", "text_crc32", "shard", "slot")
    if text not in df.columns:
        df = df.withColumn(text, F.lit(None).cast("string"))
    columns = df.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    body = text_or_empty(at[text])
    keyed = df.toDF(*at.values()).withColumns({"h": F.xxhash64(body), "id": F.coalesce(F.col(at[doc_id]).cast("long"), F.lit(LOW)), "size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(body)})
    cuts, ranges = splitters(cut(keyed.select("h", "id", "size")), shards, tolerance)
    total, sofar, rows_before, plan = sum(r["bytes"] for r in ranges), 0, {}, []
    borders = [k * total / shards for k in range(1, shards)]
    for r in ranges:
        s = bisect_right(borders, sofar + r["bytes"] / 2)
        plan.append((r["rng"], s, rows_before.get(s, 0)))
        rows_before[s] = rows_before.get(s, 0) + r["n"]
        sofar += r["bytes"]
    # RANGES boundaries and at most ROUNDS further rounds of some hundreds: the plan has a bound, whatever the input
    small = F.broadcast(df.sparkSession.createDataFrame(plan, "rng long, shard int, before long"))
    within = F.row_number().over(Window.partitionBy("rng").orderBy("h", "id")).cast("long")
    return _range_of(keyed, cuts).join(small, "rng").withColumn("slot", F.col("before") + within - 1).select(*[F.col(at[c]).alias(c) for c in columns], "size", "text_crc32", "shard", "slot")
