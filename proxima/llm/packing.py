"""Best-fit packing of token pieces into sequences by bin completion.

The plan works on the histogram of piece lengths, which has at most ``capacity`` entries however large the corpus is. First
packings are made greedily: the longest remaining piece with its best-fit filling, or with the filling that leaves least
waste, as often as the histogram allows. While they take more sequences than a lower bound, branch and bound looks for
fewer, by bisection from the bound: it branches over the undominated fillings beside the longest piece and over how often each is used, leaves a branch
when its waste exceeds what so many sequences allow, and visits branches with few departures from the first choice first.
A goal is given up when no branch is left or after WORK steps, so the packing is optimal where the search was whole.

Null texts are empty and give the one end id. Repeated rows are packed like any others; a null doc_id stays null. An empty
table gives no rows. Texts of any length are tokenised whole, word by word, in bounded batches.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, split, text_or_empty

CAPACITY, END_ID = 2048, 0
#: Nodes of one search for a filling; then the incumbent stands.
NODES = 2000
#: Steps of the branch and bound towards one number of sequences, and fillings that it considers beside one piece.
WORK, OPTIONS = 200_000, 24
#: Pieces of words whose ids a task keeps; words that are encoded together.
WORDS_KEPT, TOGETHER = 400_000, 1_000_000


#: Tokens always end between ASCII letters, single digits, and runs of ASCII punctuation other than the apostrophe.
_MARKS = rb"!-&(-/:-@\[-`{-~0-9"
SEAM = re.compile(rb"(?<=[A-Za-z0-9])(?=[" + _MARKS + rb"])|(?<=[" + _MARKS + rb"])(?=[A-Za-z0-9])")


#: Words that are one run of letters, in lower case and composed form in every version of Unicode.
SIMPLE = re.compile("[a-zß-öø-ÿа-яё\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+")


class WordIds:
    """Ids of texts, for a lower-casing tokeniser of words that drops white space.

    Such a tokeniser encodes the words of a text separately, so each distinct word is encoded once while it is remembered.
    Words of common lower-case letters go to its merges at once, others through all of its steps.
    The strings of special tokens are these tokens, wherever they stand; a text is encoded in parts between them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t, self.known = Tokenizer.from_file(path), {}
        self.special = {x.content.encode(): np.array([i], "<u4").tobytes() for i, x in self.t.get_added_tokens_decoder().items()}
        self.cuts = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.t.encode_special_tokens = True  # what else looks like them, once in lower case, is ordinary text
        # the letters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}

    def _learn(self, words: list[bytes]) -> None:
        """Adds the ids of words between seams to those known."""
        tokens, table, alone = self.t.model.tokenize, self.letters, []
        for w in words:
            if w.isascii() and w.isalpha() or SIMPLE.fullmatch(w.decode()):  # the normaliser and the splitting leave such a word as it is
                text = w.decode() if w.isascii() else w.decode("latin-1").translate(table)
                self.known[w] = array("I", [t.id for t in tokens(text)]).tobytes()
            else:
                alone.append(w)
        for at in range(0, len(alone), 5000):
            own = alone[at : at + 5000]
            for w, e in zip(own, self.t.encode_batch_fast(list(map(bytes.decode, own)), add_special_tokens=False)):
                self.known[w] = array("I", e.ids).tobytes()

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, by its pieces between seams."""
        data = list(map(self.known.get, words))
        rest = [i for i, x in enumerate(data) if x is None]
        pieces = [p.split(b" ") for p in SEAM.sub(b" ", b"\n".join([words[i] for i in rest])).split(b"\n")] if rest else []
        needed = set().union(*pieces)
        new = needed - self.known.keys()
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = needed
        self._learn(list(new))
        get = self.known.__getitem__
        for i, p in zip(rest, pieces):
            data[i] = get(p[0]) if len(p) == 1 else b"".join(map(get, p))
        return data

    def _plain(self, texts: pa.Array) -> list[bytes]:
        words, sizes = split(texts)
        coded = words.dictionary_encode()
        get = self._of_words(coded.dictionary.to_pylist()).__getitem__
        index, ends = coded.indices.to_numpy().tolist(), np.cumsum(sizes).tolist()
        return [b"".join(map(get, index[a:b])) for a, b in zip([0, *ends], ends)]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Of each text (strings without nulls) the ids as little-endian 32-bit bytes."""
        if not self.special or not any(pc.any(pc.match_substring(texts, s.decode())).as_py() for s in self.special):
            return self._plain(texts)
        parts = [self.cuts.split(t.as_buffer().to_pybytes()) for t in texts]
        flat = [x for p in parts for x in p[::2]]
        done = iter(self._plain(pa.array(flat, pa.binary()).cast(pa.string(), safe=False)))
        return [b"".join(self.special[x] if i % 2 else next(done) for i, x in enumerate(p)) for p in parts]


_OPEN: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """This worker's tokeniser; a reused worker keeps it."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


def _joined(batches, size: int):
    """Batches put together up to some bytes of text."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += batch.nbytes
        if have > size:
            yield pa.concat_batches(held)
            held, have = [], 0
    if held:
        yield pa.concat_batches(held)


def _pieces(tokenizer: str, capacity: int, keep_ids: bool):
    def run(batches):
        w = _word_ids(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in _joined(batches, 6 * TOGETHER):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), w.ids(batch.column("text"))):
                data = ids + end
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    for k, v in (("doc_id", doc), ("piece", n), ("start", at // 4), ("length", len(own) // 4), ("ids_crc32", zlib.crc32(own)), ("ids", own)):
                        out[k].append(v)
            cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, with keep_ids, the ids as little-endian 32-bit bytes."""
    small_batches(docs.sparkSession, 500)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_pieces(tokenizer, capacity, keep_ids), schema)


class _Fill:
    """The filling of a room with items of the histogram that wastes least."""

    def __init__(self, lengths: list[int], counts: dict[int, int], most: int = NODES):
        self.lengths, self.counts, self.most = lengths, counts, most  # lengths ascending; those with count 0 are removed

    def best(self, room: int, used: int | None = None) -> list[int]:
        """Item lengths, largest first, that waste least; among equals those found first, which use the largest items."""
        counts = self.counts
        left = lambda x: counts.get(x, 0) - (x == used)
        if left(room) > 0:
            return [room]  # it dominates every other filling
        greedy, r, at = [], room, len(self.lengths)
        while (at := bisect_right(self.lengths, r, 0, at)) > 0:  # best fit: the largest that fits, again and again
            x = self.lengths[at - 1]
            n = min(left(x) - greedy.count(x) if x in greedy else left(x), r // x)
            greedy += [x] * n
            r -= x * n
            at -= 1
        self.incumbent, self.waste, self.nodes, self.left = greedy, r, 0, left
        if self.waste and self.lengths and self.most:
            self.below = [0, *accumulate(x * left(x) for x in self.lengths)]
            self._search(room, len(self.lengths), [])
        return self.incumbent

    def _search(self, room: int, top: int, chosen: list[int]) -> None:
        if room < self.waste:
            self.incumbent, self.waste = list(chosen), room
        self.nodes += 1
        if not self.waste or self.nodes > self.most:
            return
        at = bisect_right(self.lengths, room, 0, top)
        while at > 0 and self.waste and self.nodes <= self.most:
            # what items up to this one can still fill: if even all of them leave as much waste, no branch here helps
            if room - self.below[at] >= self.waste:
                return
            x = self.lengths[at - 1]
            for c in range(min(self.left(x), room // x), 0, -1):
                self._search(room - c * x, at - 1, [*chosen, *[x] * c])
                if not self.waste or self.nodes > self.most:
                    return
            at -= 1


def _take(counts: dict[int, int], lengths: list[int], own: list[int], times: int) -> None:
    """Takes the pieces from the histogram, or gives them back if times is negative."""
    for x in own:
        had = counts.get(x, 0)
        counts[x] = had - times
        if not counts[x]:
            del counts[x]
            lengths.remove(x)
        elif not had:
            insort(lengths, x)


def _most(counts: dict[int, int], own: list[int]) -> int:
    return min(counts[x] // own.count(x) for x in set(own))


def _greedy(histogram: dict[int, int], capacity: int, nodes: int) -> list[tuple[int, list[int]]]:
    counts = dict(histogram)
    lengths, out = sorted(counts), []
    fill = _Fill(lengths, counts, nodes)
    while lengths:
        big = lengths[-1]
        own = [big, *fill.best(capacity - big, big)] if capacity > big else [big]
        times = _most(counts, own)
        _take(counts, lengths, own, times)
        out.append((times, own))
    return out


def bound(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound of the sequences: by the sum, and by pieces over half of the capacity with what fits beside none of them."""
    total = sum(x * n for x, n in histogram.items())
    least = -(-total // capacity)
    large = [(x, n) for x, n in histogram.items() if 2 * x > capacity]
    number = sum(n for _, n in large)
    small = 0
    for k in sorted((x for x in histogram if 2 * x <= capacity), reverse=True):
        small += k * histogram[k]  # of lengths from k to half of the capacity
        free = sum((capacity - x) * n for x, n in large if x <= capacity - k)
        least = max(least, number + max(0, -(-(small - free) // capacity)))
    return max(least, number)


def _dominated(own: list[int], waste: int, big: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether a piece left out could take the place of some of the filling's, which then fit wherever it would have gone."""
    sums = {0: 0}  # of some of the filling's pieces, with the least number of them
    for x in own[:10]:
        for v, k in list(sums.items()):
            sums[v + x] = min(sums.get(v + x, k + 1), k + 1)
    for v, k in sums.items():
        at = bisect_left(lengths, max(v, 1))
        while at < len(lengths) and lengths[at] <= v + waste:
            x = lengths[at]
            if counts[x] > own.count(x) + (x == big) and not (k == 1 and x == v and v in own):
                return True
            at += 1
    return False


class _Search:
    """Branch and bound for a packing into fewer sequences than known."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.histogram, self.capacity, self.work, self.whole = histogram, capacity, 0, True
        self.total = sum(x * n for x, n in histogram.items())

    def fillings(self, counts: dict[int, int], lengths: list[int], slack: int) -> list[tuple[int, list[int]]]:
        """(waste, filling beside the longest piece), least waste first; `whole` says whether none was left out."""
        big = lengths[-1]
        room = self.capacity - big
        left = lambda x: counts.get(x, 0) - (x == big)
        if room <= 0 or left(room) > 0:
            return [(0, [room] if room > 0 else [])]
        below = [0, *accumulate(x * left(x) for x in lengths)]
        self.work += len(lengths)
        out, nodes = {}, 0

        def go(room: int, top: int, chosen: list[int], most: int) -> None:
            nonlocal nodes
            nodes += 1
            at = bisect_right(lengths, room, 0, top)
            while at > 0 and room - below[at] <= most:
                if nodes > NODES or len(out) >= OPTIONS:
                    self.whole = False
                    return
                x = lengths[at - 1]
                for c in range(min(left(x), room // x), 0, -1):
                    go(room - c * x, at - 1, [*chosen, *[x] * c], most)
                at -= 1
            if room <= most and tuple(chosen) not in out and not _dominated(chosen, room, big, lengths, counts):
                out[tuple(chosen)] = room

        before = self.whole
        go(room, len(lengths), [], 0)
        if slack and len(out) < OPTIONS:
            self.whole = before
            self.work += nodes
            nodes = 0
            go(room, len(lengths), [], min(slack, room))
        elif slack:
            self.whole = False
        self.work += nodes
        return sorted(((w, list(f)) for f, w in out.items()), key=lambda f: f[0])

    def options(self, counts: dict[int, int], lengths: list[int], slack: int) -> list[tuple[int, int, list[int]]]:
        """(times, waste in all, pieces of one sequence): each filling as often as it can be, then less often."""
        big, out = lengths[-1], []
        for waste, filling in self.fillings(counts, lengths, slack):
            own, turn = [big, *filling], 0
            times = _most(counts, own) if not waste else min(_most(counts, own), slack // waste)
            while times:
                out.append((turn, times, times * waste, own))
                times, turn = times // 2, turn + 1
        return [o[1:] for o in sorted(out, key=lambda o: o[0])]

    def fewer(self, sequences: int) -> list[tuple[int, list[int]]] | None:
        """A packing into at most `sequences`; None if there is none or it was not found within WORK."""
        self.work = 0
        for departures in (0, 1, 2, 3, 5, 8, 16, 32, 10**9):
            self.whole = True
            made = self._within(sequences * self.capacity - self.total, departures)
            if made or self.whole or self.work > WORK:
                return made
        return None

    def _within(self, slack: int, departures: int) -> list[tuple[int, list[int]]] | None:
        counts, path = dict(self.histogram), []
        lengths = sorted(counts)
        frames = [[self.options(counts, lengths, slack), 0, departures, slack]]
        while frames and self.work <= WORK:
            options, at, more, slack = frames[-1]
            if len(path) == len(frames):
                times, own = path.pop()
                _take(counts, lengths, own, -times)
            if at == len(options) or (at and not more):
                self.whole &= at == len(options)
                frames.pop()
                continue
            frames[-1][1] += 1
            times, waste, own = options[at]
            _take(counts, lengths, own, times)
            path.append((times, own))
            self.work += 1
            if not lengths:
                return path
            frames.append([self.options(counts, lengths, slack - waste), 0, more - (at > 0), slack - waste])
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(times, lengths of one sequence)] that uses every piece of the histogram once."""
    histogram = {x: n for x, n in histogram.items() if n > 0}
    number = lambda made: sum(times for times, _ in made)
    made = min((_greedy(histogram, capacity, n) for n in (NODES, 0)), key=number)
    least, search = bound(histogram, capacity), _Search(histogram, capacity)
    goal = least
    while least < number(made):
        if better := search.fewer(goal):
            made = better
        else:
            least = goal + 1
        goal = (least + number(made) - 1) // 2
    return made


def _placed(patterns: list[tuple[int, list[int]]]):
    """Per length, the runs of ranks that a pattern takes: (first rank, per sequence, first sequence, offset in it)."""
    runs: dict[int, list] = {}
    taken: dict[int, int] = {}
    seq = 0
    for times, own in patterns:
        offset = 0
        for x in dict.fromkeys(own):
            n = own.count(x)
            runs.setdefault(x, []).append((taken.get(x, 0), n, seq, offset))
            taken[x] = taken.get(x, 0) + n * times
            offset += n * x
        seq += times
    tables = {x: np.array(r, np.int64) for x, r in runs.items()}

    def run(frames):
        for pdf in frames:
            length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            seqs, offsets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for x in np.unique(length):
                at, t = np.flatnonzero(length == x), tables[int(x)]
                r = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                k = rank[at] - r[:, 0]
                seqs[at], offsets[at] = r[:, 2] + k // r[:, 1], r[:, 3] + (k % r[:, 1]) * x
            yield pdf.assign(sequence_id=seqs, offset=offsets)

    return run


def ranked(p: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """p with rank, gapless from 0 among the pieces of a length. Frequent lengths are ranked in salted groups."""
    spark, total = p.sparkSession, sum(histogram.values())
    group = min(max(64, total // 1024), 2_000_000)
    salts = {x: n // group + 1 for x, n in histogram.items() if n > group}
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for x, s in salts.items() for v in (x, s)]), F.col("length")), F.lit(1)) if salts else F.lit(1)
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), of).cast("int"))
    sizes = p.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # about total / group rows, 1024 + capacity or N / 2,000,000
    offsets, sofar = [], {}
    for r in sorted(sizes, key=lambda r: (r["length"], r["salt"])):
        offsets.append((r["length"], r["salt"], sofar.get(r["length"], 0)))
        sofar[r["length"]] = sofar.get(r["length"], 0) + r["n"]
    before = spark.createDataFrame(offsets, "length long, salt int, before long")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return p.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("salt", "within", "before")


def pack(p: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces p(doc_id, piece, length, ids_crc32, ...) with sequence_id and offset."""
    p = cut(p)
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return p.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    placed = _placed(plan(histogram, capacity))
    r = ranked(p, histogram)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema if f.name != "rank")
    return r.mapInPandas(placed, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces that kept their ids, as rows (sequence_id, ids): at most one capacity of ids each."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("x")))), lambda s: s["x"]), "")
    return packed.groupBy("sequence_id").agg(F.unhex(ids).alias("ids"))
