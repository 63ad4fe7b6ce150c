"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over the whole text; chunks of CHUNK bytes that overlap max-pool their responses, a
dense layer, which also sees how full the chunk is, gives each chunk a logit, and the mean over all chunks gives the
document's probability (at even odds of the classes, which weigh alike in training). Training runs on the driver, on at most SAMPLE labelled documents chosen by hash, each by
all chunks of its text; training and scoring read every byte of their texts, in slices of bounded size.

Null texts count as empty, an empty text as one zero byte. Rows without a label, or with labels that contradict each other,
teach nothing; labels that are all alike give a constant smoothed score; without labels the score is 0.5. Repeated rows
get the same score; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_or_empty

FILTERS, WIDTH, BLOCK, BLOCKS, STEP = 16, 6, 64, 4, 3
#: A chunk is BLOCKS blocks, and begins STEP blocks after the one before.
CHUNK = BLOCK * BLOCKS
SAMPLE, EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 4000, 5, 300, 64, 0.01, 11
#: Positions that are convolved at a time.
SLICE = 1 << 15


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = 5, text: str = "text") -> list:
    """(id, y, whole text) of at most `sample` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(F.crc32(F.col("id").cast("string")) % modulus != 0).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y")
    known = cut(known)
    every = max(1, known.count() // (2 * sample))  # by hash, so that tasks send the driver about twice the sample in all
    few = known.where(F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(every)) == 0).orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty(text).cast("binary").alias("t")).join(F.broadcast(few), "id")
    rows = own.select("id", "y", "t").dropDuplicates(["id"]).collect()
    return sorted(((r["id"], r["y"], bytes(r["t"])) for r in rows), key=lambda r: (hash_of(r[0]), r[0]))


def hash_of(x: int) -> int:
    return (x * 0x9E3779B97F4A7C15) & (2**64 - 1)


class Net:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, dense: np.ndarray, offset: float):
        self.filters, self.bias, self.dense, self.offset = filters, bias, dense, offset

    @staticmethod
    def fresh() -> Net:
        r = np.random.default_rng(SEED)
        return Net(r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.append(r.normal(0, 0.1, FILTERS), 0).astype(np.float32), 0.0)

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Of each position that has WIDTH bytes; data: uint8."""
        n = len(data) - WIDTH + 1
        out = self.filters[0][data[:n]]
        more = np.empty_like(out)
        for k in range(1, WIDTH):
            np.take(self.filters[k], data[k : k + n], axis=0, out=more)
            out += more
        return out

    def slices(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Yields (i, j, responses from starts[i] to ends[j - 1]) for blocks i to j; blocks, whose positions are starts to ends, are in order."""
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
            yield i, j, self.responses(padded[starts[i] : ends[j - 1] + WIDTH - 1])
            i = j

    def block_maxima(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The largest response of each block."""
        out = np.empty((len(starts), FILTERS), np.float32)
        for i, j, got in self.slices(padded, starts, ends):
            bounds = np.column_stack([starts[i:j], ends[i:j]]).ravel()[:-1] - starts[i]  # what lies between blocks is reduced on its own
            out[i:j] = np.maximum.reduceat(got, bounds, axis=0)[::2]
        return np.maximum(out + self.bias, 0)

    def block_peaks(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each block, without bias, and its position."""
        top, where = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int64)
        for i, j, got in self.slices(padded, starts, ends):
            at = np.minimum(starts[i:j, None] + np.arange(BLOCK), ends[i:j, None] - 1) - starts[i]  # a short block repeats its last position
            own = got[at]
            top[i:j] = own.max(1)
            first = (own == top[i:j, None]).argmax(1)
            where[i:j] = starts[i:j, None] + first
        return top, where

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """One per text, from all of its bytes."""
        data, starts, ends, blocks, chunks, length = _layout(texts)
        top = self.block_maxima(data, starts, ends)
        pooled = top[blocks[:, 0]]
        for k in range(1, BLOCKS):
            np.maximum(pooled, top[blocks[:, k]], out=pooled)
        each = pooled @ self.dense[:-1] + _fill(length) * self.dense[-1]
        return np.add.reduceat(each, np.cumsum(chunks) - chunks) / chunks + self.offset


def _layout(texts: list[bytes]):
    """The padded bytes, starts and ends of blocks, the blocks of each chunk, the number of chunks of each text, the bytes of each chunk."""
    texts = [t or b"\0" for t in texts]
    data = np.frombuffer(b"".join(t + b"\0" * (WIDTH - 1) for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + WIDTH - 1) - (sizes + WIDTH - 1)
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(begins, blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * BLOCK
    ends = np.minimum(starts + BLOCK, np.repeat(begins + sizes, blocks))
    chunks = np.maximum(1, -(-(blocks - BLOCKS) // STEP) + 1)
    at = np.repeat(first, chunks) + (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * STEP
    last = np.repeat(first + blocks - 1, chunks)
    length = np.minimum(np.repeat(sizes, chunks) - (at - np.repeat(first, chunks)) * BLOCK, CHUNK)
    return data, starts, ends, np.minimum(at[:, None] + np.arange(BLOCKS), last[:, None]), chunks, length


def _fill(length: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(length, 1) / CHUNK)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list) -> Net:
    """Adam on the logistic loss; gradients pass through the position of each maximum only."""
    net = Net.fresh()
    y = np.array([r[1] for r in rows], np.float64)
    good = (y.sum() + 1) / (len(y) + 2)
    net.offset = float(np.log(good / (1 - good)))
    if len(set(y.tolist())) < 2:
        net.dense[:] = 0
        return net
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    net.offset = 0.0
    params = [net.filters, net.bias, net.dense, np.array([net.offset], np.float32)]
    m, v, r, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], np.random.default_rng(SEED), 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(rows) // BATCH)))  # small samples are seen more often
    for epoch in range(epochs):
        for batch in np.array_split(r.permutation(len(rows)), -(-len(rows) // BATCH)):
            data, starts, ends, blocks, per, sizes = _layout([rows[i][2] for i in batch])
            doc = np.repeat(np.arange(len(batch)), per)
            top, peak = net.block_peaks(data, starts, ends)
            best = top[blocks].argmax(1)  # of the chunk's blocks
            of = np.take_along_axis(blocks, best, 1)
            f = np.broadcast_to(np.arange(FILTERS), of.shape)
            raw, where = top[of, f], peak[of, f]
            h = np.maximum(raw + net.bias, 0)
            h = np.column_stack([h, _fill(sizes)]).astype(np.float32)
            z = np.bincount(doc, h @ net.dense, len(batch)) / per + params[3][0]
            loss = (_sigmoid(z) - y[batch]) * weight[batch]
            d = (loss / len(batch))[doc] / per[doc]
            back = np.where(h[:, :-1] > 0, d[:, None] * net.dense[None, :-1], 0).astype(np.float32)
            grad = [np.zeros_like(net.filters), back.sum(0), (d[:, None] * h).sum(0).astype(np.float32), np.array([loss.mean()], np.float32)]
            for k in range(WIDTH):
                cell = data[where + k].astype(np.int64) * FILTERS + f
                grad[0][k] = np.bincount(cell.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            for p, g, a, b2 in zip(params, grad, m, v):
                a += 0.1 * (g - a)
                b2 += 0.001 * (g * g - b2)
                p -= RATE * (0.3 if epoch == epochs - 1 else 1) * (a / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-8)
    net.offset = float(params[3][0])
    return net


def _scored(net: Net):
    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column("t")]
            score = _sigmoid(net.logits(texts)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def model(docs: DataFrame, labels: DataFrame) -> Net:
    rows = labelled(docs, labels)
    if rows:
        return train(rows)
    net = Net.fresh()
    net.dense[:] = 0
    return net


def scored(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """docs with score, the probability of good quality; a column of that name is replaced."""
    small_batches(docs.sparkSession, 500)
    inner = docs.drop("score")
    renamed = inner.toDF(*[f"c{i}" for i in range(len(inner.columns))]).withColumn("t", text_or_empty(f"c{inner.columns.index(text)}").cast("binary"))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema))
    out = renamed.mapInArrow(_scored(net), f"{schema}, score double")
    return out.toDF(*inner.columns, "score")
