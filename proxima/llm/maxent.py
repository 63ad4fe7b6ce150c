"""Hashed maximum-entropy language model with class-factored softmax, and unigram base scores.

Leaves are the end of a text, the WORDS most frequent training words, and SHAPES groups of all other words by their last two
bytes. They stand in a tree of DEPTH levels of BRANCH classes, subclasses and members, in which words that occur in like
contexts stand together. P(token | history) is the product of a softmax at each node on the leaf's path, times the share of
the word in its group: add-one, with one unseen word. So the words' probabilities add up to one after any history.

Every softmax has the same features: the word before (n-gram), the second word before (skip) and, at the root, both (n-gram).
A feature at a node is a row of a hashed table whose size follows the number of training tokens. Biases are those of the
unigram model. All weights start at zero and are learned by gradients of the log likelihood: the training texts are dealt to
SLICES by hash, and each slice in turn gives one distributed update. Tasks walk their texts with the current weights, count the
outcomes that come and, in place of the expected outcomes, one drawn from the model's own distribution at each node; the
difference of the counts is an unbiased gradient, made of whole numbers, so it does not depend on how the rows are dealt.
One training text in JUDGES moves no weights but tells how well the model predicts: once an update betters that by less than
LEAST_GAIN, or after PASSES passes, training ends, but not before all other texts have taught.

The most frequent words go to every task with their counts (HEAD rows at most); counts of all other words are
found by a join, so base scores are exact for the whole vocabulary. Null texts are empty (one token, the end); without training
texts every count is zero and weights stay zero; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches, split, text_or_empty

HEAD, SHAPES, BRANCH, DEPTH, CONTEXTS = 262_144, 256, 16, 3, 64
LEAVES = BRANCH**DEPTH
WORDS = LEAVES - 1 - SHAPES
NODES = sum(BRANCH**level for level in range(DEPTH))
#: Training tokens per row of the hashed table, and the bits of its size at least and at most (BRANCH weights a row).
TOKENS_PER_ROW, LEAST_BITS, MOST_BITS = 1024, 14, 19
#: Updates of a pass, passes at most, gain (share of the nats) below which training ends, training texts per text that judges.
SLICES, PASSES, LEAST_GAIN, JUDGES = 6, 4, 0.004, 128
RATE, DAMP, STEP, WEIGHT = 0.5, 4.0, 1.5, 8.0
#: Values of a block in which tasks return sums; tokens that meet the table at a time; tokens that a task counts together.
BLOCK, CHUNK, TOGETHER = 4096, 4096, 1_500_000


# ---- tokens
def shapes(words: pa.Array) -> np.ndarray:
    """The group of each word (bytes, none of them empty)."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, begin, end = np.frombuffer(data, np.uint8), ends[:-1], ends[1:]
    before = np.where(end - begin > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return (31 * data[end - 1].astype(np.int64) + before) % SHAPES


def _counted(batches):
    held: list[pa.Array] = []
    size = 0

    def out():
        words = pa.chunked_array(held, pa.binary()).combine_chunks()
        found = pc.value_counts(words)
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["w", "n"])

    for batch in batches:
        words, _ = split(batch.column("text").filter(pc.invert(batch.column("held_out"))))
        held.append(words)
        size += len(words)
        if size > TOGETHER:
            yield out()
            held, size = [], 0
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c) of the words of prepared docs(held_out, text) that are not held out."""
    return docs.select("held_out", "text").mapInArrow(_counted, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c"))


class Head:
    """The most frequent words by count, descending: their counts, items, and what items that are groups add to a score."""

    def __init__(self, words: pa.Array, counts: np.ndarray, group: np.ndarray, ends: int, base: float):
        self.words = words
        self.logs = np.log10(counts + 1.0)
        rank = np.arange(len(words))
        self.items = np.where(rank < WORDS, 1 + rank, 1 + WORDS + shapes(self.words)).astype(np.uint16)
        self.add = np.where(rank < WORDS, 0.0, self.logs + group[np.maximum(self.items.astype(np.int64) - 1 - WORDS, 0)])
        self.group, self.end, self.base = group, float(np.log10(ends + 1.0)), base
        self.ends_known = int(ends > 0)


def _numbered(sent):
    """Texts as items, with the parts of their scores that need no model, and their words outside of the head."""

    def run(batches):
        from pyspark import TaskContext

        h = sent.value
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            words, sizes = split(batch.column("text"))
            n, rows = len(words), len(sizes)
            found = pc.index_in(words, value_set=h.words)
            index = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
            rest = np.flatnonzero(index < 0)
            unknown = words.take(pa.array(rest))
            kinds = shapes(unknown)
            at = np.maximum(index, 0)
            items, logs, add = (t[at] if len(t) else np.zeros(n, t.dtype) for t in (h.items, h.logs, h.add))
            items[rest], logs[rest], add[rest] = 1 + WORDS + kinds, 0.0, h.group[kinds]
            doc = np.repeat(np.arange(rows), sizes)
            per = lambda x: np.bincount(doc, x, rows)
            ends = np.cumsum(sizes + 1)
            all_items = np.zeros(n + rows, np.uint16)
            all_items[np.arange(n) + doc] = items
            data, begins = all_items.tobytes(), np.concatenate([[0], ends[:-1]])
            ids = pa.array([data[2 * a : 2 * b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())
            tail = pa.table({"d": pa.array(doc[rest]), "w": unknown}).group_by(["d", "w"], use_threads=False).aggregate([([], "count_all")]).sort_by("d").combine_chunks()
            offsets = np.concatenate([[0], np.cumsum(np.bincount(tail["d"].to_numpy(), minlength=rows))])
            column = lambda name: tail[name].chunk(0) if tail[name].num_chunks else tail[name].combine_chunks()
            tails = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([column("w"), column("count_all").cast(pa.int32())], names=["w", "n"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + rows)), batch.column("doc_id"), batch.column("held_out"), batch.column("slice"), pa.array(sizes + 1), pa.array(per(index >= 0).astype(np.int64) + h.ends_known), pa.array(per(logs) + h.end - (sizes + 1) * h.base), pa.array(per(add)), ids, tails],
                names=["rid", "doc_id", "held_out", "slice", "n_tokens", "known", "base", "add", "ids", "tail"],
            )
            rid += rows

    return run


NUMBERED = "rid long, doc_id long, held_out boolean, slice int, n_tokens long, known long, base double, add double, ids binary, tail array<struct<w:binary,n:int>>"


def walk(ids: pa.Array):
    """(one, two, items, begins) of the texts' tokens: the item before, the one before that; before a text there are ends."""
    parts = [np.frombuffer(x.as_buffer(), np.uint16) for x in ids]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))  # at least one, the end
    items = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    begins = np.cumsum(sizes) - sizes
    one = np.roll(items, 1)
    one[begins] = 0
    two = np.roll(one, 1)
    two[begins] = 0
    return one, two, items, begins


# ---- sums over all training texts
def _totals(task, sizes: int):
    """A task's totals as blocks of whole numbers: task(state, ids) adds to its array; empty blocks are left out; block -1 has reals."""

    def run(batches):
        state, reals = np.zeros(-(-sizes // BLOCK) * BLOCK, np.int32), np.zeros(2)
        for batch in batches:
            if batch.num_rows:
                reals += task(state, batch)
        v = state.reshape(-1, BLOCK)
        some = np.flatnonzero(v.any(1))
        for at in range(0, len(some), 256):
            own = some[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([v[i].tobytes() for i in own], pa.binary())], names=["block", "v"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([reals.tobytes()], pa.binary())], names=["block", "v"])

    return run


def _sums(frames):
    """Streams blocks into sums; holds one sum per block of its partition."""
    import pandas as pd

    sums: dict[int, np.ndarray] = {}
    for pdf in frames:
        for b, v in zip(pdf["block"], pdf["v"]):
            own = np.frombuffer(v, np.float64 if b < 0 else np.int32).astype(np.float64)
            sums[b] = sums[b] + own if b in sums else own
    if sums:
        yield pd.DataFrame({"block": list(sums), "v": [v.tobytes() if b < 0 else v.astype(np.float32).tobytes() for b, v in sums.items()]})


def totals(numbered: DataFrame, task, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums over the texts of what tasks count: an array of the size given, and two real numbers.

    There is one task per core, so that what is sent follows the cluster's size and the array's, not the number of files.
    """
    own = numbered.select("ids", "slice").coalesce(max(2, numbered.sparkSession.sparkContext.defaultParallelism))
    rows = own.mapInArrow(_totals(task, size), "block int, v binary").repartition("block").mapInPandas(_sums, "block int, v binary").collect()
    out, reals = np.zeros(-(-size // BLOCK) * BLOCK, np.float32), np.zeros(2)
    for r in rows:
        if r["block"] < 0:
            reals += np.frombuffer(bytes(r["v"]), np.float64)
        else:
            out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["v"]), np.float32)
    return out[:size], reals


# ---- the tree
def _context(items: np.ndarray) -> np.ndarray:
    """A context of few: the end and the most frequent words each, all others by hash."""
    own = CONTEXTS // 2
    return np.where(items < own, items, own + (items.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(16)) % (CONTEXTS - own)).astype(np.int64)


def _cooccurrence(state, batch):
    one, _, items, begins = walk(batch.column("ids"))
    after = np.roll(items, -1)
    after[np.append(begins[1:], len(items)) - 1] = 0
    cells = state[: 2 * CONTEXTS * LEAVES].reshape(2, -1)
    for side, near in enumerate((one, after)):
        cells[side] += np.bincount(_context(near) * LEAVES + items, minlength=CONTEXTS * LEAVES)
    return 0.0


def tree(counts: np.ndarray) -> np.ndarray:
    """A leaf for each item: items are halved, again and again, along the direction in which their contexts differ most."""
    m = counts.reshape(2 * CONTEXTS, LEAVES).T.astype(np.float64)
    mass, share = m.sum(1), m.sum(0) / max(1.0, m.sum())
    x = np.sqrt((m + 4 * share) / (mass[:, None] + 4))  # Hellinger distances, shrunk to the mean where little was seen
    parts = [np.arange(LEAVES)]
    while len(parts[0]) > 1:
        halves = []
        for own in parts:
            y = x[own] - x[own].mean(0)
            if len(own) > len(share):
                along = y @ np.linalg.eigh(y.T @ y)[1][:, -1]
            else:
                along = np.linalg.eigh(y @ y.T)[1][:, -1]
            along = along * np.sign(along[np.abs(along).argmax()] or 1)
            order = np.argsort(np.round(along, 9), kind="stable")
            halves += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        parts = halves
    leaf = np.empty(LEAVES, np.int32)
    leaf[np.concatenate(parts)] = np.arange(LEAVES)
    return leaf


# ---- the model
class Model:
    """leaf: of each item. bias: of each node. table: rows of the hashed features, halves of it for n-grams of one word."""

    def __init__(self, leaf: np.ndarray, bias: np.ndarray, table: np.ndarray):
        self.leaf, self.bias, self.table = leaf, bias, table

    def levels(self, one: np.ndarray, two: np.ndarray, leaf: np.ndarray):
        """Per level: (nodes, rows of each feature, branch taken)."""
        bits = len(self.table).bit_length() - 1
        a, b = self.leaf[one].astype(np.uint32) + np.uint32(1), self.leaf[two].astype(np.uint32) + np.uint32(1)
        first, more = np.uint32(33 - bits), np.uint32(34 - bits)  # shifts to half and to a quarter of the rows
        out, nodes = [], 0
        for level in range(DEPTH):
            under = BRANCH ** (DEPTH - level)
            node = (leaf // under + nodes).astype(np.uint32)
            rows = [((a * np.uint32(512) + node) * np.uint32(2654435769)) >> first, (((b * np.uint32(512) + node) * np.uint32(2246822507)) >> more) + np.uint32(len(self.table) // 2)]
            if not level:
                both = a * np.uint32(668265263) ^ b * np.uint32(2654435769)
                rows.append((((both ^ (both >> np.uint32(15))) * np.uint32(3266489917)) >> more) + np.uint32(len(self.table) // 4 * 3))
            out.append((node.astype(np.int64), [r.astype(np.int64) for r in rows], (leaf // (under // BRANCH)) & (BRANCH - 1)))
            nodes += BRANCH**level
        return out

    def logits(self, node: np.ndarray, rows: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
        """Into x, with y as room."""
        np.take(self.bias, node, axis=0, out=x, mode="clip")
        for r in rows:
            np.take(self.table, r, axis=0, out=y, mode="clip")
            x += y

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, items: np.ndarray, drawn: np.ndarray | None = None):
        """Natural logs, one per token; with drawn (a number in [0, 1) per token and level), also (rows, taken, drawn branch) per level."""
        n, out, draws, places = len(items), np.zeros(len(items), np.float32), [], np.arange(CHUNK) * BRANCH
        x, y, ones, upto = np.empty((CHUNK, BRANCH), np.float32), np.empty((CHUNK, BRANCH), np.float32), np.ones(BRANCH, np.float32), np.triu(np.ones((BRANCH, BRANCH), np.float32))
        for level, (node, rows, taken) in enumerate(self.levels(one, two, self.leaf[items])):
            got, taken = np.empty(n, np.int64), taken.astype(np.int64)
            for at in range(0, n, CHUNK):
                own = slice(at, min(n, at + CHUNK))
                m = own.stop - at
                self.logits(node[own], [r[own] for r in rows], x[:m], y[:m])
                out[own] += x.ravel()[places[:m] + taken[own]]
                np.exp(x[:m], out=x[:m])
                if drawn is None:
                    out[own] -= np.log(x[:m] @ ones)
                else:
                    sums = x[:m] @ upto
                    out[own] -= np.log(sums[:, -1])
                    below = sums < (drawn[level][own] * sums[:, -1])[:, None]
                    eight = np.bitwise_count(below.view(np.uint64))  # a byte of 0 or 1 for each branch
                    got[own] = np.minimum(eight[:, 0] + eight[:, 1], BRANCH - 1)
            draws.append((rows, taken, got))
        return out if drawn is None else (out, draws)


def _chances(ids: pa.Array, begins: np.ndarray, n: int, turn: int) -> np.ndarray:
    """A number in [0, 1) per level and token, from the text, the token's place and the turn."""
    seeds = np.array([zlib.crc32(x.as_buffer(), turn) for x in ids], np.uint32)
    sizes = np.diff(np.append(begins, n))
    place = np.repeat(seeds, sizes) + (np.arange(n) - np.repeat(begins, sizes)).astype(np.uint32) * np.uint32(2654435769)
    out = np.empty((DEPTH, n), np.float32)
    for level in range(DEPTH):
        x = place ^ np.uint32(0x9E3779B9 * (level + 1) % 2**32)
        x = (x ^ (x >> np.uint32(16))) * np.uint32(2246822507)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(3266489909)
        out[level] = ((x ^ (x >> np.uint32(16))) >> np.uint32(8)).astype(np.float32) * np.float32(2**-24)
    return out


def _gradient(sent, turn: int):
    """Counts of the outcomes that came, then of those drawn; of the texts that judge, (log likelihood, tokens)."""

    def task(state, batch):
        m, judging = sent.value, pc.equal(batch.column("slice"), SLICES)
        ids = batch.column("ids").filter(judging)
        one, two, items, _ = walk(ids)
        judged = np.array([m.log_probabilities(one, two, items).sum(dtype=np.float64), len(items)])
        ids = batch.column("ids").filter(pc.invert(judging))
        one, two, items, begins = walk(ids)
        size = m.table.size
        came, drew, once = state[:size], state[size : 2 * size], np.ones(len(items), np.int32)
        for rows, taken, got in m.log_probabilities(one, two, items, _chances(ids, begins, len(items), turn))[1]:
            for r in rows:
                cell = r * BRANCH
                np.add.at(came, cell + taken, once)
                np.add.at(drew, cell + got, once)
        return judged

    return task


def _biases(mass: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Per node the log shares of what stands below its branches, of leaves' masses; leaves that stand for nothing get next to nothing."""
    mass = np.where(real, mass + 0.5, 1e-9)
    out = []
    for level in range(DEPTH):
        share = mass.reshape(BRANCH ** (level + 1), -1).sum(1).reshape(-1, BRANCH)
        out.append(np.log(share / share.sum(1, keepdims=True)))
    return np.concatenate(out).astype(np.float32)


def learned(numbered: DataFrame, model: Model) -> Model:
    """The model after its updates; numbered texts have a slice from 0 to SLICES - 1, or SLICES if they judge."""
    spark, before, size = numbered.sparkSession, -np.inf, model.table.size
    for turn in range(PASSES * SLICES):
        sent = spark.sparkContext.broadcast(model)
        counts, (logp, tokens) = totals(numbered.where(F.col("slice").isin(turn % SLICES, SLICES)), _gradient(sent, turn), 2 * size)
        sent.unpersist()
        came, drew = counts[:size], counts[size:]
        step = (came - drew) * np.float32(RATE)
        came += drew
        came *= np.float32(0.5)
        came += np.float32(DAMP)
        step /= came
        table = model.table + np.clip(step, -STEP, STEP, out=step).reshape(-1, BRANCH)
        model = Model(model.leaf, model.bias, np.clip(table, -WEIGHT, WEIGHT, out=table))
        del counts, came, drew, step, table
        now = logp / max(1.0, tokens)
        if turn >= SLICES - 1 and now - before < LEAST_GAIN * -now:
            break
        before = now
    return model


def _scored(sent):
    def run(batches):
        m, log10 = sent.value, 1 / np.log(10)
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, items, begins = walk(batch.column("ids"))
            p = m.log_probabilities(one, two, items).astype(np.float64)
            model = pc.add(batch.column("add"), pa.array(np.add.reduceat(p, begins) * log10))
            names = ["rid", "doc_id", "held_out", "n_tokens", "known", "base"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), model], names=[*names, "model"])

    return run


def fit(docs: DataFrame):
    """(numbered texts, model, N, V, counts) of the prepared docs(doc_id, held_out, slice, text)."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    texts = docs.where(~F.col("held_out")).count()
    # a histogram of counts (64 bins a doubling) gives the least bin with which the head stays within its bound; of a bin that is
    # larger than all of the head, words are taken by their hashes' histogram
    level, order = F.floor(F.log2("c") * 64), F.pmod(F.xxhash64("w"), F.lit(4096))
    above, least, part = 0, None, 0
    for r in sorted(counts.groupBy(level.alias("b")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["b"]):
        if above + r["k"] > HEAD:
            part = int(4096 * (HEAD - above) / r["k"] * 0.9)
            least = r["b"]
            break
        above, least = above + r["k"], r["b"] - 1
    top = counts.where((level > least) | ((level == least) & (order < part)) if least is not None else F.lit(False)).select("w", "c").toArrow()
    top = top.sort_by([("c", "descending"), ("w", "ascending")]).combine_chunks()
    words, numbers = (top[c].combine_chunks() for c in ("w", "c"))
    words, numbers = words.cast(pa.binary()), numbers.to_numpy(zero_copy_only=False).astype(np.float64)
    del top
    by_shape = counts.groupBy(F.expr(f"(31 * cast(conv(hex(substring(w, -1, 1)), 16, 10) as int) + if(octet_length(w) > 1, cast(conv(hex(substring(w, -2, 1)), 16, 10) as int), 0)) % {SHAPES}").alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in by_shape:
        mass[r["s"]], kinds[r["s"]] = r["n"], r["v"]
    few = words[:WORDS]
    for c, s in zip(numbers.tolist(), shapes(few).tolist()):
        mass[s] -= c
        kinds[s] -= 1
    tokens, distinct = int(n) + texts, int(v) + (texts > 0)
    head = Head(words, numbers, -np.log10(mass + kinds + 1), texts, float(np.log10(tokens + distinct + 1)))
    at = scratch(spark, "lm")
    docs.mapInArrow(_numbered(spark.sparkContext.broadcast(head)), NUMBERED).write.partitionBy("slice").parquet(at)
    numbered = spark.read.schema(NUMBERED).parquet(at)
    training = numbered.where("slice >= 0")
    cells = 2 * CONTEXTS * LEAVES
    leaf = tree(totals(training, _cooccurrence, cells)[0])
    of_leaf, real = np.zeros(LEAVES), np.zeros(LEAVES, bool)
    of_leaf[leaf] = np.concatenate([[texts], numbers[:WORDS], np.zeros(WORDS - len(few)), mass])
    real[leaf] = np.concatenate([[True], np.arange(WORDS) < len(few), np.ones(SHAPES, bool)])
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, tokens / TOKENS_PER_ROW))))))
    model = Model(leaf, _biases(of_leaf, real), np.zeros((1 << bits, BRANCH), np.float32))
    return numbered, learned(training, model), tokens, distinct, counts


def prepared(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2
    body = text_or_empty(text)
    part = F.when(held, F.lit(-1)).when(F.pmod(F.xxhash64(body, F.lit(31)), F.lit(JUDGES)) == 0, F.lit(SLICES)).otherwise(F.pmod(F.xxhash64(body, F.lit(29)), F.lit(SLICES)).cast("int"))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), part.alias("slice"), body.alias("text"))


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    numbered, model, n, v, counts = fit(prepared(docs, text, doc_id))
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double"
    rows = numbered.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "add", "ids").mapInArrow(_scored(spark.sparkContext.broadcast(model)), schema)
    tail = numbered.select("rid", F.explode("tail").alias("t")).select("rid", "t.w", "t.n")
    more = tail.join(counts, "w").groupBy("rid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_log"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.join(more, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_log")).alias("base_score"), (F.col("model") + zero("more_log")).alias("score"),
    )
