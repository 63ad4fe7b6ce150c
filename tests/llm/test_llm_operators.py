"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=0, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(80)]
    out = [" ".join(r.choice(vocab) + r.choice(["", "", ".", ",", "!"]) for _ in range(r.randint(1, 120))).capitalize() for _ in range(n)]
    out += [None, "", "   \n", "one", "a b c", out[0], out[0], out[1].replace(" ", "  ", 2), "x" * 3000, ("lang text " * 2500).strip(), "Tabs\tand\r\nlines\n\nlines\nlines", "日本語 テキスト 😀", "it's 'S don't 12.5 #tag <a|b> \x1c\x85 end"]
    out += [" ".join([*out[2].split(), "tail"]), out[3].upper()]
    return out


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en" if i % 2 else None, f"s{i % 3}", i) for i, t in enumerate(rows)]
    return spark.createDataFrame([*data, data[0], (None, "no id", "en", "s1", 1)] if rows else [], DOC)


def clash(df):
    """df with columns whose names operators might use."""
    return df.withColumns({c: F.lit("x") for c in ("h", "id", "rng", "size", "shard", "slot", "score", "t", "fp", "g", "w", "spans", "kept", "__n", "n_words", "value")})


def body(t):
    return t or ""


# ---- sharding
def test_sharding(spark):
    from proxima.llm.sharding import shard

    d = clash(docs(spark))
    got = shard(d, 4).collect()
    assert len(got) == d.count()
    for r in got:
        b = body(r["text"]).encode()
        assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b) and r["value"] == "x"
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert shard(docs(spark, []), 4).count() == 0


def test_sharding_divides_only_hot_texts(spark):
    from proxima.llm.sharding import shard

    rows = ["hot " * 40] * 3000 + [f"text {i} " * (1 + i % 9) for i in range(4000)]
    got = shard(docs(spark, rows), 8).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 8 and by.max() / by.min() < 1.03
    cold = got[got["text"].str.startswith("text")].groupby("text")["shard"].nunique()
    assert cold.max() == 1


# ---- search
def test_search(spark):
    from proxima.llm.search import quantised, top_k

    r = np.random.default_rng(0)
    rows = [(i, (r.normal(size=6) / 3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)] + [(400, None), (450, [None, 1.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, []), (650, [0.5]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit("x"))
    q = quantised(df)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in top_k(q, q.where("vec_id % 50 = 0"), 5).collect()}
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = {}
    for i in (x for x in ok if x % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ok[i], v)), j) for j, v in ok.items() if j != i)[:5]
        expected |= {(i, n): (j, -s) for n, (s, j) in enumerate(scores, 1)}
    assert got == expected and 650 in {k[0] for k in got}
    none = quantised(df.where("false"))
    assert top_k(none, none, 5).count() == 0


def test_ball_tree_prunes_and_is_exact():
    from proxima.llm.search import BallTree, Best

    r = np.random.default_rng(1)
    pts = np.floor(np.concatenate([r.normal(c, 3, (200, 4)) for c in (-300, -100, 0, 100, 300)]))
    tree, seen = BallTree(np.arange(1000), pts, 20), []
    queries = pts[::100]
    best = Best(np.arange(0, 1000, 100), 3, np.full(10, -np.inf))
    tree.search(best.qids, queries, best.kth, 3, lambda w, i, s: (seen.append(len(w) * len(i)), best.keep(w, i, s)))
    for q, own in zip(range(0, 1000, 100), best.found):
        assert own == sorted((-int(pts[q] @ pts[j]), j) for j in range(1000) if j != q)[:3]
    assert sum(seen) < 5000
    huge = BallTree(np.arange(2), np.array([[2.0**40, 1], [2.0**40, -1]]), 20)
    assert huge._scores(np.array([[2.0**40, 1]]), huge.points).tolist() == [[2**63 - 1] * 2]


# ---- packing
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    return path, t


def test_packing(spark):
    from proxima.llm.packing import pack, pieces, sequences

    path, t = tokenizer()
    d = clash(docs(spark))
    packed = pack(pieces(d, path)).cache()
    rows = packed.collect()
    want = Counter()
    for x in d.collect():
        ids = t.encode(body(x["text"]), add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[x["doc_id"], n, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    total = 0
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
    assert len({r["sequence_id"] for r in rows}) == -(-total // 2048)
    for r in sequences(packed).collect():
        own = sorted((x for x in rows if x["sequence_id"] == r["sequence_id"]), key=lambda x: x["offset"])
        assert bytes(r["ids"]) == b"".join(bytes(x["ids"]) for x in own)
    assert pack(pieces(docs(spark, []), path)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_against_all_partitions(seed):
    from proxima.llm.packing import plan

    r = random.Random(seed)
    items = [r.randint(1, 12) for _ in range(8)]

    def least(rest, bins):
        if not rest:
            return len(bins)
        best = len(bins) + len(rest)
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + rest[0] <= 12:
                best = min(best, least(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]]))
        return min(best, least(rest[1:], [*bins, rest[0]]))

    made = plan(Counter(items), 12)
    assert Counter(x for n, own in made for x in own * n) == Counter(items) and all(sum(own) <= 12 for _, own in made)
    assert sum(n for n, _ in made) == least(sorted(items, reverse=True), [])


def test_bin_completion_backs_out_of_a_first_filling():
    """1228 takes 635 and 185 first, which leaves pieces that fill no sequence."""
    from proxima.llm.packing import plan

    want = {x: 1000 for x in (1228, 1126, 635, 287, 1023, 840, 185)} | {410: 2000}
    made, got = plan(want), Counter()
    for times, own in made:
        got.update({x: times * own.count(x) for x in own})
        assert sum(own) <= 2048
    assert got == want and sum(n for n, _ in made) == 3000


@pytest.mark.parametrize("seed", range(4))
def test_planted_full_sequences(seed):
    """Histograms that three-piece full sequences were cut into, with repeats, are packed without waste."""
    from proxima.llm.packing import plan

    r, want, bins = random.Random(seed), Counter(), 0
    for _ in range(4):
        a, b = sorted(r.sample(range(100, 1948), 2))
        times = r.randint(1, 500)
        bins += times
        for x in (a, b - a, 2048 - b):
            want[x] += times
    assert sum(n for n, _ in plan(want)) == bins


def test_hot_length(spark):
    from proxima.llm.packing import pack

    p = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 < 2, 700).otherwise(5 + F.col("id") % 600).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    rows = pack(p).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("offset").alias("o")).collect()
    assert all(r["n"] <= 2048 and r["k"] == r["o"] for r in rows) and sum(r["k"] for r in rows) == 5000
    assert len(rows) <= -(-sum(r["n"] for r in rows) // 2048) * 1.25


# ---- near-duplicates
def brute_fingerprint(t, words=4):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), body(t)))
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, limit):
    up = {i: i for i in range(len(ids))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                up[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def test_queries_that_repeat_an_id_ask_once(spark):
    from proxima.llm.search import top_k

    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "vec_id long, q array<double>")
    got = top_k(v, v.where("vec_id in (3, 4)").unionByName(v.where("vec_id = 3")), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(3, 1, 11), (3, 2, 10), (4, 1, 11), (4, 2, 10)]


def test_special_tokens_as_the_plain_call_gives_them():
    from proxima.llm.packing import WordIds

    path, t = tokenizer()
    texts_ = ["<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "x <|startoftext|><|endoftext|>", "7a-b'll 3rd (x) don't 12.5%", "é́ <|", ""]
    for text, ids in zip(texts_, WordIds(path).ids(pa.array(texts_))):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_simhash(spark):
    from proxima.llm.simhash import near_duplicates

    d = docs(spark, texts() + [texts()[7] + f" w{i}" for i in range(6)])
    rows = d.collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    want = brute_components([r["doc_id"] for r in rows], prints, 4)
    got = Counter(tuple(r) for r in near_duplicates(clash(d)).collect())
    assert got == Counter((r["doc_id"], f"{p:016x}", c) for r, p, c in zip(rows, prints, want))
    assert near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("group", [4096, 16])
def test_links_over_hot_groups(spark, group, monkeypatch):
    """Many fingerprints near one another, which tiling has to keep together."""
    from proxima.llm import simhash
    from proxima.llm.components import components

    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(5)
    base = r.getrandbits(64)
    prints = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)}
    signed = {x - 2**64 if x >= 2**63 else x: x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["id"]: r["component"] for r in components(simhash.links(df)).collect()}
    order = sorted(signed)
    want = brute_components(order, [signed[x] for x in order], 4)
    assert {x: got.get(x, x) for x in order} == dict(zip(order, want))


def test_one_of_each_keeps_the_smallest(spark):
    from proxima.llm.simhash import one_of_each

    long = " ".join(f"w{i}" for i in range(300))
    d = spark.createDataFrame([(3, long), (1, long), (2, "other text here now and then"), (2, "other text here now and then"), (None, long)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1) for r in one_of_each(d, words=5).collect())
    assert got == [-1, 1, 2]


def test_components_of_a_long_path(spark):
    from proxima.llm.components import components

    got = components(spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


# ---- quality rules
def brute_counts(t):
    t, seen, dup = body(t), set(), 0
    w = WORD.findall(t)
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeat = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat))
    return (*counts, len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def test_base_counts(spark):
    from proxima.llm.quality_rules import judged

    d = docs(spark, [*texts(), "a b c " * 30, "a a a a", "x\ny\nx\n \n \nx", "q w e r t y " * 9 + "u i o p"])
    got = Counter(tuple(r)[:7] for r in judged(clash(d), keep=["doc_id"]).drop("distance", "kept").collect())
    assert got == Counter((r["doc_id"], *brute_counts(r["text"])) for r in d.collect())
    assert judged(docs(spark, []), keep=["doc_id"]).count() == 0


def test_least_determinant_against_random_starts(spark):
    """Two groups of vectors with a fifth of outliers: no random start of a plain search finds a core of smaller determinant, and
    the same rows are far away."""
    from proxima.llm import quality_rules as Q

    r, rows, floor = np.random.default_rng(5), [], np.array(list(Q.FLOORS.values())) ** 2
    for g in range(2):
        mix = r.normal(size=(7, 7))
        x = r.normal(size=(240, 7)) @ mix + g
        x[:48] = x[:48] + 60 * (1 + g)
        rows += [(f"g{g}", *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{z} double" for z in Q.Z))
    est, groups = Q.estimates(df)
    assert groups == 2
    got = {e["g"]: e for e in est.collect()}
    far = {(e["g"], e["z0"]): e["d"] for e in df.join(est, "g").withColumn("d", Q._distance()).collect()}
    for g in ("g0", "g1"):
        x = np.array([v[1:] for v in rows if v[0] == g])
        h, best = int(0.75 * len(x)), (np.inf, None)
        for _ in range(60):
            own = r.choice(len(x), 8, replace=False)
            for _ in range(25):
                m, c = x[own].mean(0), np.cov(x[own].T, bias=True) + np.diag(floor)
                d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
                own = np.argsort(d, kind="stable")[:h]
            det = np.linalg.slogdet(np.cov(x[own].T, bias=True) + np.diag(floor))[1]
            best = min(best, (det, tuple(d)))
        assert got[g]["logdet"] < best[0] + 0.1
        d = np.array(best[1])
        mine = np.array([far[g, v[1]] for v in rows if v[0] == g])
        assert set(np.argsort(-d)[:48]) == set(np.argsort(-mine)[:48]) == set(range(48))


def test_long_texts_repeat_windows(spark, monkeypatch):
    """Beyond 65,536 windows places are told apart by whole hashes."""
    from proxima.llm.quality_rules import judged

    r = random.Random(4)
    words = [f"w{r.randrange(10**7)}" for _ in range(66_000)]
    words[65_000:65_010] = words[10:20]
    d = spark.createDataFrame([(1, " ".join(words)), (2, "a b c d " + " ".join(words[:60]) + " a b c")], "doc_id long, text string")
    assert {x["doc_id"]: x["n_repeat_words"] for x in judged(d, keep=["doc_id"]).collect()} == {x["doc_id"]: brute_counts(x["text"])[4] for x in d.collect()}


def test_outliers_are_rejected_and_others_kept(spark):
    from proxima.llm.quality_rules import judged, kept

    r = random.Random(2)
    plain = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 300)))
    rows = [plain() for _ in range(200)] + ["### ".join(plain().split()) for _ in range(20)] + [plain().upper() for _ in range(20)]
    d = docs(spark, rows)
    got = {r["doc_id"]: r["kept"] for r in judged(d, keep=["doc_id"]).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(200, 240))
    assert {r["doc_id"] for r in kept(clash(d)).collect()} == {k for k, v in got.items() if v}


# ---- BPE
def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    from proxima.llm.bpe import decode, digests, encode, ranks_of

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    d = clash(docs(spark, [*texts(), "<|endoftext|> x", "b\x00c  d \n e\n\nf ", "ab" * 300]))
    want = Counter()
    for r in d.collect():
        ids = e.encode_ordinary(body(r["text"]))
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(body(r["text"]).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in digests(d, path, pattern).collect()) == want
    back = decode(encode(d, path, pattern), path, pattern)
    assert Counter((r["doc_id"], bytes(r["data"])) for r in back.collect()) == Counter((r["doc_id"], body(r["text"]).encode()) for r in d.collect())
    assert digests(docs(spark, []), path, pattern).count() == 0


def test_long_words(monkeypatch):
    import public_tokenizers
    import tiktoken

    from proxima.llm import bpe

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    monkeypatch.setattr(bpe, "PART", 40)
    b = bpe.Bpe(path, pattern)
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=b.ranks, special_tokens={})
    r = random.Random(4)
    for t in ("a" * 333, "ab" * 100, "".join(r.choice("abcdei") for _ in range(300)), "été" * 60):
        assert ",".join(b.encode([t])[0]) == ",".join(map(str, e.encode_ordinary(t)))


def test_frequent_words_stay_known(monkeypatch):
    import public_tokenizers

    from proxima.llm import bpe

    monkeypatch.setattr(bpe, "KEPT", 40)
    b = bpe.Bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    asked, encode_words = Counter(), b.encode_words
    monkeypatch.setattr(b, "encode_words", lambda words: asked.update(words) or encode_words(words))
    letters = "bcdfghjklm"
    for i in range(20):
        rare = " ".join(f"q{letters[i // 10]}{letters[i % 10]}{c}zu" for c in letters)
        b.encode([f"Drostimer {rare} vexanible.", f"Drostimer {rare}"])
    assert asked[b"Drostimer"] == asked[b" vexanible"] == 1 and len(asked) > 200


def test_pieces_of_mixed_batches():
    import public_tokenizers
    import pyarrow as pa
    import tiktoken

    from proxima.llm import bpe

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    b = bpe.Bpe(path, pattern)
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=b.ranks, special_tokens={})
    r = random.Random(5)
    mixed = lambda: "".join(r.choice(" \n\t\x00\u3000'a.,1-é😀sZ_~") for _ in range(r.randint(0, 12)))
    even = lambda: r.choice(" \n").join("".join(r.choice("'a.,1-é😀sZ_~\x00") for _ in range(r.randint(1, 6))) for _ in range(4))
    rows = ["", *(r.choice((mixed, even))() for _ in range(600)), ""]
    want = [",".join(map(str, e.encode_ordinary(t))) for t in rows]
    assert list(map(",".join, b.encode(rows))) == want
    assert b.encode([]) == [] and b.encode(["", ""]) == [[], []]
    coded, which, ends = b.numbered(pa.array(rows).slice(200, 300))
    assert [",".join(coded[i][0] for i in which[x:y]) for x, y in zip(ends, ends[1:])] == want[200:500]
    assert [b"".join(coded[i][1] for i in which[x:y]) for x, y in zip(ends, ends[1:])] == [t.encode() for t in rows[200:500]]


# ---- personal data
def brute_spans(t):
    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, body(t)) if ok(m.group()))


PII = [
    "mail a.b@c.de, x@y and a@b.co_z@d.org!", "é😀 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00255.0.0.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (555) 123-4567 +12 3 +1 22 333 4444 55555 6666 7", "+49.30.1234567.", "@ @@ a@b..c 1..2", "12 34 " * 400, "a@" * 500 + "b.c", "+" * 300 + "1" * 400, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ok', "call (212) 555 0101 or ssn: 123-45-6789", "it was on 2001-02-03 with order 12345678901",
]


def test_base_spans(spark):
    from proxima.llm.pii import found

    d = docs(spark, [*texts(), *PII])
    got = Counter((r["doc_id"], tuple(tuple(s) for s in r["base_spans"])) for r in found(clash(d)).collect())
    assert got == Counter((r["doc_id"], tuple(brute_spans(r["text"]))) for r in d.collect())
    assert found(docs(spark, [])).count() == 0


def test_added_spans_and_redaction(spark):
    from proxima.llm.pii import KINDS, found, redact

    d = docs(spark, PII)
    for r in found(d).collect():
        base, spans = {tuple(s) for s in r["base_spans"]}, [tuple(s) for s in r["spans"]]
        assert base <= set(spans) and spans == sorted(spans)
    texts_ = {r["doc_id"]: r["text"] for r in redact(d).collect()}
    assert texts_[0] == "mail [EMAIL], x@y and [EMAIL][EMAIL]!"
    assert texts_[9] == 'token = "[SECRET]" ok'
    assert texts_[10] == "call [NUMBER] or ssn: [NUMBER]" and texts_[11] == PII[11]
    assert redact(docs(spark, [None])).where("doc_id = 0 and text is null").count() == 2 and len(KINDS) == 7


def test_added_spans_against_a_plain_search(spark):
    """Generators, features, trees and thresholds again, by loops over plain matches."""
    import regex
    from proxima.llm import pii as P

    r = random.Random(9)
    parts = [b + s + a for b, s, a, _ in P._examples()]
    texts_ = [" ".join(r.sample(parts, r.randint(1, 4))) for _ in range(250)] + PII + ["é😀 (415) 555-0132x tel. 4155550132", "0" * 40 + "a" * 20, "a [at] b"]
    d = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    trees, limits = P.model(spark)
    distinct = spark.range(1).select(F.size(F.array_distinct(F.split(F.lit("ab"), "")))).first()[0] - 2  # whether the split ends with nothing
    digits = lambda m: "".join(c for c in m if c in "0123456789")

    def luhn(x):
        return bool(x) and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(map(int, reversed(x)))) % 10 == 0

    def vector(kind, m, before, after):
        has = lambda p, t, flags=0: float(bool(regex.search(p, t, flags | regex.ASCII)))
        n = lambda p: float(sum(bool(regex.match(p, c)) for c in m))
        said = lambda w: has(rf"(?:{w})", before, regex.I)
        return [
            float(kind), float(len(m)), float(len(digits(m))), n("[A-Za-z]"), n("[A-Z]"), n("[^A-Za-z0-9]"), float(len(set(m)) + distinct),
            float(luhn(digits(m))), has("^[0-9a-f]+$", m), has(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", m), has(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$", m),
            has(r"^[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}$", m), has(r"^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}", m), has(r"^[0-9]+(?:\.[0-9]+)+$", m),
            said("token|key|secret|passw|auth|bearer|credential"), said(r"phone|tel\b|tel[.:]|call|mobile|fax|contact"), said("card|visa|credit|account|iban|ssn|social|passport"), has("[=:\"']\\s?[\"']?$", before),
            said("order|isbn|version|page|commit|sha|ref|invoice|part|serial|build|total|code"), has("^[A-Za-z]", after),
        ]

    def value(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    accept = {4: lambda m: True, 5: lambda m: len(digits(m)) >= 7, 6: lambda m: len(m) >= 16 and regex.search("[0-9]", m) and regex.search("[A-Za-z]", m)}
    added = 0
    for row in P.found(d).collect():
        t, base = row["text"], [tuple(s) for s in row["base_spans"]]
        want = list(base)
        for kind, pattern in ((4, P.ADDRESS), (5, P.NUMBER), (6, P.SECRET)):
            found = [m.span() for m in regex.finditer(pattern, t)]
            for (a, b), follows in zip(found, [*(x for x, _ in found[1:]), len(t)]):
                m = t[a:b]
                if not accept[kind](m) or any(s < b and a < e for s, _, e in base):
                    continue
                x, score = vector(kind, m, t[max(0, a - 28) : a], t[b:follows][:2]), 0.0
                for tree in trees:
                    score += P.RATE * value(tree, x)
                if score >= limits[kind]:
                    want.append((a, kind, b))
                    added += 1
        assert [tuple(s) for s in row["spans"]] == sorted(want), t
    assert added > 50


# ---- classifier
def test_classifier(spark):
    from proxima.llm.cnn import model, scored

    r = random.Random(3)
    plain = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 200)))
    rows = [plain() if i % 3 else "## ".join(plain().split()) for i in range(400)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    net = model(d, labels)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    s = {r["doc_id"]: r["score"] for r in scored(d, net).collect()}
    assert np.mean([(s[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    # flipping the labels of held-out rows changes nothing
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(net.filters, model(d, other).filters)
    got = scored(clash(docs(spark)), net)
    assert got.where("score between 0 and 1").count() == got.count() == docs(spark).count() and got.columns[-1] == "score"
    empty = model(d, labels.where("false"))
    assert {r["score"] for r in scored(docs(spark), empty).collect()} == {0.5}
    assert scored(docs(spark, []), net).count() == 0


def test_every_byte_counts():
    """Scores by chunks written out, for texts around the sizes of blocks and chunks, alone and together."""
    from proxima.llm.cnn import BLOCK, BLOCKS, CHUNK, STEP, WIDTH, Net

    net, r = Net.fresh(), np.random.default_rng(0)
    net.dense[-1] = 0.3
    many = [r.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 5, 63, 64, 65, 255, 256, 257, 400, 448, 449, 5000, 70000)]
    got = net.logits(many)
    for t, g in zip(many, got):
        t = t or b"\0"
        data = np.frombuffer(t + b"\0" * (WIDTH - 1), np.uint8)
        h = np.maximum(net.responses(data) + net.bias, 0)
        blocks = -(-len(t) // BLOCK)
        chunks = max(1, -(-(blocks - BLOCKS) // STEP) + 1)
        each = [h[c * STEP * BLOCK : c * STEP * BLOCK + CHUNK].max(0) @ net.dense[:-1] + np.log(min(CHUNK, len(t) - c * STEP * BLOCK) / CHUNK) * net.dense[-1] for c in range(chunks)]
        assert abs(np.mean(each) + net.offset - g) < 1e-4


def test_training_reads_whole_texts(spark):
    """Long texts that are bad for one passage, wherever it is: six windows of each saw it in few of them."""
    from proxima.llm.cnn import labelled, model, scored

    r = random.Random(4)

    def text(bad):
        t = "".join(r.choice("abcdefghij ") for _ in range(12_000))
        at = r.randrange(600, 1000)
        return t[:at] + "ZQ#XV!" * 150 + t[at + 900 :] if bad else t

    rows = [(i, text(i % 2 == 0)) for i in range(160)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    assert {x[0]: x[2].decode() for x in labelled(d, labels)} == {i: t for i, t in rows if zlib.crc32(str(i).encode()) % 5}
    s = {x["doc_id"]: x["score"] for x in scored(d, model(d, labels)).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [s[i] for i in held if i % 2], [s[i] for i in held if not i % 2]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


# ---- language model
def test_language_model(spark):
    from proxima.llm.maxent import scored

    d = docs(spark)
    rows = d.collect()
    words = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), body(t)).encode().split()
    held = lambda x: zlib.crc32(("" if x is None else str(x)).encode()) % 7 == 2
    c, ends = Counter(), 0
    for r in rows:
        if not held(r["doc_id"]):
            c.update(words(r["text"]))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    got = sorted(scored(clash(d)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["base_score"]))
    assert len(got) == len(rows)
    for r, x in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), got):
        w = words(r["text"])
        base = sum(math.log10((c[y] + 1) / (n + v + 1)) for y in w) + math.log10((ends + 1) / (n + v + 1))
        assert (x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (r["doc_id"], held(r["doc_id"]), len(w) + 1, sum(c[y] > 0 for y in w) + 1, n)
        assert abs(x["base_score"] - base) < 1e-6 * max(1, abs(base)) and math.isfinite(x["score"]) and x["score"] < 0
    assert scored(docs(spark, [])).count() == 0


def test_language_model_learns_context(spark):
    from proxima.llm.maxent import scored

    r = random.Random(1)
    rows = [" ".join(r.choice("abcdefghijklmnopqrst") + "xy"[i % 2] for _ in range(60)) for i in range(300)]  # two languages
    got = [x for x in scored(docs(spark, rows)).collect() if x["held_out"]]
    assert len(got) > 20 and sum(x["score"] for x in got) > 0.9 * sum(x["base_score"] for x in got)


def test_rare_words_are_counted_by_the_join(spark, monkeypatch):
    from proxima.llm import maxent

    whole = {(r["doc_id"], r["text"]) for r in docs(spark).collect()}
    before = sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in maxent.scored(docs(spark)).collect())
    monkeypatch.setattr(maxent, "HEAD", 20)
    after = sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in maxent.scored(docs(spark)).collect())
    assert before == after and len(whole) > 50


def test_scores_against_a_plain_walk_of_the_tree(spark):
    """Every text's score by loops over its tokens and the tree; after any history the words' probabilities add up to one."""
    from proxima.llm import maxent as M

    d = docs(spark)
    numbered, m, n, v, counts = M.fit(M.prepared(d))
    c = {bytes(r["w"]): r["c"] for r in counts.collect()}
    items = {w: 1 + i for i, w in enumerate(sorted(c, key=lambda w: (-c[w], w))[: M.WORDS])}
    rows, bits = len(m.table), len(m.table).bit_length() - 1
    shape = lambda w: (31 * w[-1] + (w[-2] if len(w) > 1 else 0)) % M.SHAPES
    item = lambda w: 0 if w is None else items.get(w, 1 + M.WORDS + shape(w))
    mass = Counter()
    for w in c:
        if w not in items:
            mass[shape(w)] += c[w] + 1

    def softmax(one, two, level, node):
        a, b, u = int(m.leaf[one]) + 1, int(m.leaf[two]) + 1, 2**32
        x = m.bias[node] + m.table[(a * 512 + node) * 2654435769 % u >> (33 - bits)] + m.table[rows // 2 + ((b * 512 + node) * 2246822507 % u >> (34 - bits))]
        if not level:
            both = a * 668265263 % u ^ b * 2654435769 % u
            x = x + m.table[rows // 4 * 3 + ((both ^ both >> 15) * 3266489917 % u >> (34 - bits))]
        e = np.exp(x.astype(np.float64))
        return e / e.sum()

    def leaves(one, two):
        p = np.ones(1)
        for level, first in enumerate((0, 1, 1 + M.BRANCH)):
            p = np.concatenate([p[k] * softmax(one, two, level, first + k) for k in range(len(p))])
        return p

    assert np.abs(m.table).max() > 0.1
    for one, two in ((0, 0), (1, 0), (5, 3), (4000, 7)):
        p = leaves(one, two)
        words = sum(p[m.leaf[i]] for i in [0, *items.values()]) + sum(p[m.leaf[1 + M.WORDS + g]] * sum([(mass[g] + 1) / (mass[g] + 1)]) for g in range(M.SHAPES))
        assert abs(p.sum() - 1) < 1e-9 and abs(words - 1) < 1e-6
    texts_ = {}
    for r in d.collect():
        texts_[r["doc_id"]] = [w.lower() for w in body(r["text"]).encode().split()] if r["doc_id"] not in texts_ else None
    seen = 0
    for r in M.scored(d).collect():
        words = texts_[r["doc_id"]]
        if words is None or len(words) > 300:
            continue
        total, one, two = 0.0, 0, 0
        for w in [*words, None]:
            i, p = item(w), 1.0
            leaf = int(m.leaf[i])
            for level, (first, under) in enumerate(((0, 256), (1, 16), (1 + M.BRANCH, 1))):
                p *= softmax(one, two, level, first + leaf // under // M.BRANCH)[leaf // under % M.BRANCH]
            if i > M.WORDS:
                p *= (c.get(w, 0) + 1) / (mass[i - 1 - M.WORDS] + 1)
            total, one, two = total + math.log10(p), i, one
        assert abs(r["score"] - total) < 1e-4 * max(1, abs(total))
        seen += 1
    assert seen > 30


# ---- WARC
def test_warc(spark):
    from proxima.llm.warc import roundtrip

    rows = [(i, f"http://h/{i}?q=é \r\n x", t) for i, t in enumerate(["same"] * 30 + [f"page {i}\r\n\r\nWARC/1.1" for i in range(30)] + [None, "", "x" * 300_000, "é😀"])] + [(None, "u", "same"), (5, "http://h/5", "same"), (61, None, "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = roundtrip(d.repartition(5), payloads=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[body(t)] = min(i, first.get(body(t), i))
    want = Counter()
    for i, _, t in rows:
        b, leader = body(t).encode(), first.get(body(t))
        revisit = leader is not None and leader != i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", leader if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["verified"] and len(r["payload"]) == r["payload_bytes"] for r in got if r["record_type"] == "response")
    assert roundtrip(d.where("false")).count() == 0


def test_a_cut_archive_is_refused():
    import io

    from proxima.llm.warc import inflated, record_bytes, records_in

    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = whole.compress(b"".join(record_bytes(i, "u", b"p" * 999, None, None) for i in range(9))) + whole.flush()
    assert len(list(records_in(inflated(io.BytesIO(data))))) == 9
    with pytest.raises(ValueError):
        list(records_in(inflated(io.BytesIO(data[:-20]))))


# ---- near-duplicates of the pipeline
def shingle_set(t, words=5):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), body(t)).split()
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_kept(rows, words=5):
    """One row per component over exact Jaccard similarity 0.8."""
    sets, up = [shingle_set(t, words) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        least[root(i)] = min((x is None, x or 0), least.get(root(i), (True, 0)))
    return Counter(None if none else x for none, x in least.values())


def near_copies(seed, words=300):
    """Texts and copies of each at similarities on both sides of 0.8, chains of copies and one large group."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out = []
    for edits in [1, 2, 3, 4, 5, 6, 6, 7, 7, 8, 9, 12] * 8:
        base = [word() for _ in range(words)]
        copy = list(base)
        for i in r.sample(range(0, words, 6), edits):
            copy[i] = word()
        out += [" ".join(base), " ".join(copy)]
    base = [word() for _ in range(words)]
    for _ in range(60):
        copy = list(base)
        for i in r.sample(range(0, words, 6), r.randint(1, 6)):
            copy[i] = word()
        out.append(" ".join(copy))
    for _ in range(8):
        base[r.randrange(words)] = word()
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize("full", [4, 0])
def test_near_duplicates_against_exact_jaccard(spark, full, monkeypatch):
    """Fingerprints within 7 bits left many of these pairs in; full = 0 takes rounds of centres."""
    from proxima.llm import neardup

    monkeypatch.setattr(neardup, "FULL", full)
    rows = list(enumerate(near_copies(3) + texts()))
    random.Random(1).shuffle(rows)
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(r["doc_id"] for r in got.collect()) == brute_kept(rows)
    assert neardup.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_make_no_rows_of_unlike_pairs(spark, monkeypatch):
    """Copies whose similarity to each other is below 0.8 share groups; what is written grows with sets, not with their pairs."""
    from proxima.llm import neardup

    r, n, written = random.Random(5), 120, []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(300)], []
    for i in range(n):
        copy = list(base)
        for at in r.sample(range(0, 300, 6), 5):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    cut = neardup.cut
    monkeypatch.setattr(neardup, "FULL", 10**9)
    monkeypatch.setattr(neardup, "cut", lambda df, *old: written.append((df.columns, (out := cut(df, *old)).count())) or out)
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(x["doc_id"] for x in got.collect()) == brute_kept(rows)
    assert max(k for columns, k in written if columns == ["a", "b"]) <= 3 * n


def test_near_duplicates_without_or_with_repeated_ids(spark):
    """Different texts of one id both stay; copies without id do not."""
    from proxima.llm.neardup import one_of_each

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    d = spark.createDataFrame([(None, a), (None, a), (7, b), (7, c), (7, c), (9, c), (None, c)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"][0]) for r in one_of_each(d).collect())
    assert got == Counter([(None, "a"), (7, "b"), (7, "c")])
