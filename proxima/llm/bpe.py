"""Byte-level BPE by recursive DuckDB queries, and decoding by ordered aggregation.

A task holds one DuckDB with the merge table (left token, right token) -> merged token of a rank file. Words that are not
tokens themselves become rows (word, position, token, next position, next token); a recursive query contracts each word's
leftmost pair of least rank until no word has a pair. Very long words are first cut where no token of the vocabulary
spans the two bytes, and the parts go through the same step in a loop that keeps only the current state and contracts all
occurrences of the least pair at once where no pair that this creates can have a lower rank.

Distinct words are encoded once while a task remembers them, and decoded from their ids likewise; a document's ids are
those of its words in order, put together by numbers of distinct words. Null texts are empty: no tokens. Repeated rows
are encoded like any others; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

#: A task remembers this many pieces of text to twice as many; bytes of the words that one query takes; the longest word in it.
KEPT, QUERY_BYTES, LONG = 400_000, 400_000, 64
#: A part of a long word up to this many bytes takes the recursive query, whose rows grow with the square.
PART = 2000
#: White space as the patterns of tokenisers see it, beyond blank and newline.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

#: Texts whose pieces only the whole pattern finds: two kinds of white space meet, or there is other white space.
UNEVEN = r"[ \n][ \n]|[" + "".join(f"\\x{{{ord(c):x}}}" for c in OTHER_SPACE) + "]"
#: Elsewhere words of the pattern always end before a blank, around a newline, and between an ASCII letter or digit and ASCII
#: punctuation other than the apostrophe: where a byte and the next share a bit.
BEFORE, AFTER = np.full(256, 1, np.uint8), np.full(256, 2, np.uint8)
AFTER[list(b" \n")] |= 1
BEFORE[ord("\n")] |= 2
BEFORE[[c for c in range(128) if chr(c).isalnum()]] |= 4
AFTER[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] |= 4
BEFORE, AFTER = BEFORE.tobytes(), AFTER.tobytes()

PAIRS = "SELECT q.w, q.pos, q.nxt, (m.m::BIGINT << 32) | q.pos AS o, m.m FROM {rows} q JOIN merges m ON ((q.tok::BIGINT << 32) | q.ntok) = m.k"
#: One contraction of each word's first pair of least rank; `dead` is the position that goes.
CONTRACT = f"""
SELECT p.w, p.pos,
  CASE WHEN p.pos = b.pos THEN b.m ELSE p.tok END AS tok,
  CASE WHEN p.pos = b.pos THEN b.nnxt ELSE p.nxt END AS nxt,
  CASE WHEN p.nxt = b.pos THEN b.m WHEN p.pos = b.pos THEN b.nntok ELSE p.ntok END AS ntok,
  p.it + 1 AS it
FROM st p JOIN (
  SELECT c.w, c.pos, c.m, c.nxt AS dead, d.nxt AS nnxt, d.ntok AS nntok
  FROM (SELECT w, arg_min(pos, o) AS pos, arg_min(nxt, o) AS nxt, (min(o) >> 32)::INT AS m FROM ({PAIRS.format(rows='st')}) GROUP BY w) c
  JOIN st d ON d.w = c.w AND d.pos = c.nxt) b ON p.w = b.w
WHERE p.pos <> b.dead"""
LINKED = "SELECT a.w, a.pos, a.tok, b.pos AS nxt, b.tok AS ntok, 0 AS it FROM {rows} a LEFT JOIN {rows} b ON a.w = b.w AND b.pos = a.pos + 1"
ENCODE = f"""
WITH RECURSIVE st(w, pos, tok, nxt, ntok, it) AS ({LINKED.format(rows='ws')} UNION ALL {CONTRACT})
SELECT w, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids FROM st JOIN (SELECT w, max(it) AS it FROM st GROUP BY w) USING (w, it) GROUP BY w ORDER BY w"""
#: The step for one long word: every occurrence of its least pair, from the left and without overlap, or the first only.
LONG_STEP = """
CREATE OR REPLACE TABLE long_next AS
WITH n AS (SELECT *, lead(tok) OVER (ORDER BY pos) AS ntok, row_number() OVER (ORDER BY pos) AS i FROM long_now),
hit AS (SELECT n.i, m.m, n.tok = n.ntok AS twin FROM n JOIN merges m ON ((n.tok::BIGINT << 32) | n.ntok) = m.k),
least AS (SELECT i, m, i - row_number() OVER (ORDER BY i) AS run, twin FROM hit WHERE m = (SELECT min(m) FROM hit)),
taken AS (SELECT i, m FROM least l WHERE (NOT twin OR (i - (SELECT min(i) FROM least x WHERE x.run = l.run)) % 2 = 0)
          AND (i = (SELECT min(i) FROM least) OR m IN (SELECT m FROM safe)))
SELECT n.pos, coalesce(t.m, n.tok)::INT AS tok FROM n LEFT JOIN taken t ON n.i = t.i WHERE n.i - 1 NOT IN (SELECT i FROM taken)"""
DECODE = "SELECT s.w, unhex(string_agg(v.hex, '' ORDER BY s.pos)) AS bytes FROM seqs s JOIN vocab v ON s.tok = v.tok GROUP BY s.w ORDER BY s.w"


def remembered(kept: list[dict], keys: list, make: Callable[[list], list]) -> list:
    """make's values for distinct keys, or those in `kept`: its first dictionary takes what is seen, once full it replaces the second."""
    young, old = kept
    values = list(map(young.get, keys))
    unseen = [i for i, v in enumerate(values) if v is None]
    for i in unseen:
        values[i] = old.get(keys[i])
    new = [i for i in unseen if values[i] is None]
    for i, value in zip(new, make([keys[i] for i in new]), strict=True):
        values[i] = value
    if len(young) + len(unseen) > KEPT:
        kept[:] = dict(zip(keys, values)), young
    else:
        young.update((keys[i], values[i]) for i in unseen)
    return values


def listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def joined(parts: pa.Array, which: np.ndarray, ends: np.ndarray, by) -> pa.Array:
    """For each row, whose numbers end at `ends`, the parts that its numbers name, joined."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), parts.take(pa.array(which))), by)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = ranks_of(path)
        # \s as Unicode defines white space, without the separators \x1c-\x1f
        space = r"\x20\n" + "".join(f"\\u{ord(c):04x}" for c in OTHER_SPACE)
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]"))
        left, right, merged, pairs = [], [], [], set()
        for token, rank in self.ranks.items():
            pairs.update(zip(token, token[1:]))
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        k = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        m = np.array(merged, np.int64)
        lowest = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int64).max)
        for side in (left, right):
            np.minimum.at(lowest, np.array(side), m)
        self.spanned = np.zeros((256, 256), bool)
        if pairs:
            self.spanned[tuple(np.array(list(pairs)).T)] = True
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for name, columns in {"merges": {"k": k, "m": m.astype(np.int32)}, "safe": {"m": np.flatnonzero(lowest > np.arange(len(lowest))).astype(np.int32)}, "vocab": {"tok": np.array(list(self.ranks.values()), np.int32), "hex": [t.hex() for t in self.ranks]}}.items():
            self._load(name, columns)
        self.of_piece: list[dict[str, tuple[str, bytes]]] = [{}, {}]

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("arriving", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arriving").fetchall()
        self.db.unregister("arriving")

    def _rows(self, words: list[bytes]) -> dict:
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(n)
        return {"w": np.repeat(np.arange(len(words), dtype=np.int32), n), "pos": (np.arange(ends[-1]) - np.repeat(ends - n, n)).astype(np.int32), "tok": self.first[np.frombuffer(b"".join(words), np.uint8)]}

    def encode_words(self, words: list[bytes]) -> list[str]:
        """The decimal ids of each word, joined by commas."""
        out, rest, size = [""] * len(words), [], 0
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = str(whole)
            elif len(w) > LONG:
                out[i] = self._long(w)
            else:
                rest.append(i)
                size += len(w)
                if size > QUERY_BYTES:
                    self._query(rest, words, out)
                    rest, size = [], 0
        self._query(rest, words, out)
        return out

    def _query(self, rest: list[int], words: list[bytes], out: list[str]) -> None:
        if rest:
            self._load("ws", self._rows([words[i] for i in rest]))
            for i, ids in zip(rest, listed(self.db.sql(ENCODE).to_arrow_table().column("ids")), strict=True):
                out[i] = ids

    def _long(self, word: bytes) -> str:
        b = np.frombuffer(word, np.uint8)
        cuts = np.flatnonzero(~self.spanned[b[:-1], b[1:]]) + 1  # no token has these two bytes side by side
        out: list[str] = []
        for part in (word[i:j] for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)])):
            if len(part) == 1:
                out.append(str(self.first[part[0]]))
                continue
            if len(part) <= PART:
                self._load("ws", self._rows([part]))
                out.append(self.db.execute(ENCODE).fetchall()[0][1])
                continue
            self._load("long_now", {k: v for k, v in self._rows([part]).items() if k != "w"})
            n, before = len(part), 0
            while n != before:
                self.db.execute(LONG_STEP).fetchall()
                self.db.execute("CREATE OR REPLACE TEMP TABLE long_now AS SELECT * FROM long_next").fetchall()
                before, n = n, self.db.execute("SELECT count(*) FROM long_now").fetchall()[0][0]
            out += [str(t) for (t,) in self.db.execute("SELECT tok FROM long_now ORDER BY pos").fetchall()]
        return ",".join(out)

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces that the pattern treats separately, where those of each text end, from 0)."""
        texts = texts.cast(pa.large_string())
        uneven = np.flatnonzero(pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False))
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = (data or pa.py_buffer(b"")).slice(at[0], at[-1] - at[0]).to_pybytes()
        at = at - at[0]
        bound = np.zeros(len(data) + 1, bool)
        bound[1:-1] = np.frombuffer(data.translate(BEFORE), np.uint8)[:-1] & np.frombuffer(data.translate(AFTER), np.uint8)[1:] != 0
        bound[at] = True
        starts = np.flatnonzero(bound)
        ends = np.searchsorted(starts, at)
        found = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
        if not len(uneven):
            return found, ends
        parts, sizes, last = [], np.diff(ends), 0
        for i in uneven.tolist():
            own = self.words.findall(texts[i].as_py())
            parts += [found[last : ends[i]], pa.array(own, pa.large_string())]
            sizes[i], last = len(own), ends[i + 1]
        return pa.concat_arrays([*parts, found[last:]]), np.concatenate([[0], np.cumsum(sizes)])

    def _ids(self, new: list[str]) -> list[str]:
        """The decimal ids of each piece, joined by commas."""
        plain = [p for p in new if p.isalpha() or p[0] == " " and p[1:].isalpha()]  # one word of the pattern
        out = dict(zip(plain, self.encode_words(list(map(str.encode, plain)))))
        rest = {p: self.words.findall(p) for p in new if p not in out}
        words = list(set().union(*rest.values()))
        ids = dict(zip(words, self.encode_words(list(map(str.encode, words)))))
        out.update((p, ",".join(map(ids.__getitem__, ws))) for p, ws in rest.items())
        return [out[p] for p in new]

    def numbered(self, texts: pa.Array) -> tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray]:
        """(distinct pieces as ids, decimal and joined by commas, and as the bytes that these ids decode to; which of them the pieces have, in order; where those of each text end, from 0)."""

        def both(new: list[str]) -> list[tuple[str, bytes]]:
            ids = self._ids(new)
            return list(zip(ids, self.decode(ids), strict=True))

        found, ends = self.pieces(texts)
        coded = found.dictionary_encode()
        return remembered(self.of_piece, listed(coded.dictionary), both), coded.indices.to_numpy(), ends

    def encode(self, texts: list[str]) -> list[list[str]]:
        """Per text, the decimal ids of its pieces, each piece's joined by commas."""
        coded, which, ends = self.numbered(pa.array(texts, pa.string()))
        return [[coded[i][0] for i in which[a:b].tolist()] for a, b in zip(ends, ends[1:])]

    def decode(self, sequences: list[str]) -> list[bytes]:
        """The bytes of id sequences, decimal ids joined by commas."""
        if not sequences:
            return []
        lists = pc.split_pattern(pa.array(sequences, pa.large_string()), ",")
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        tokens = lists.flatten().cast(pa.int32()).to_numpy()
        self._load("seqs", {"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "pos": (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), "tok": tokens})
        return listed(self.db.sql(DECODE).to_arrow_table().column("bytes"))


_OPEN: dict[tuple[str, str], Bpe] = {}


def _bpe(path: str, pattern: str) -> Bpe:
    """This worker's coder; a reused worker keeps it."""
    if (path, pattern) not in _OPEN:
        _OPEN.clear()
        _OPEN[path, pattern] = Bpe(path, pattern)
    return _OPEN[path, pattern]


def _encoded(path: str, pattern: str, out: str):
    def run(batches):
        coder = _bpe(path, pattern)
        for batch in batches:
            coded, which, ends = coder.numbered(batch.column("text"))
            parts = pa.array([ids for ids, _ in coded], pa.large_string())
            tokens = np.concatenate([[0], np.cumsum((pc.count_substring(parts, ",").to_numpy() + 1)[which])])[ends]
            whole = joined(parts, which, ends, pa.scalar(",", pa.large_string()))
            if out == "ids":
                numbers = pc.split_pattern(whole.filter(pc.not_equal(whole, "")), ",").flatten().cast(pa.int32())
                columns = {"n_tokens": np.diff(tokens), "ids": pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), numbers)}
            else:
                decoded = joined(pa.array([data for _, data in coded], pa.large_binary()), which, ends, pa.scalar(b"", pa.large_binary()))
                columns = {"n_tokens": np.diff(tokens), "ids_sha256": [hashlib.sha256(s.as_buffer()).hexdigest() for s in whole], "decoded_sha256": [hashlib.sha256(d.as_buffer()).hexdigest() for d in decoded]}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns})

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>)."""
    small_batches(docs.sparkSession, 500)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_encoded(path, pattern, "ids"), "doc_id long, n_tokens long, ids array<int>")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes and decodes every text: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    small_batches(docs.sparkSession, 500)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_encoded(path, pattern, "digests"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decoded(path: str, pattern: str):
    def run(batches):
        coder = _bpe(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            coded = lists.flatten().dictionary_encode()
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            parts = coder.decode(list(map(str, listed(coded.dictionary))))
            data = joined(pa.array(parts, pa.large_binary()), coded.indices.to_numpy(), ends, pa.scalar(b"", pa.large_binary()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "data": data.cast(pa.binary())})

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data) of encoded(doc_id, ids); null ids are an empty sequence."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path, pattern), "doc_id long, data binary")
