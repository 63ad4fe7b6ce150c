"""Personal data: base patterns, and candidates that boosted trees judge.

Main path: DataFrame functions only. ``regexp_extract_all`` and ``split`` with one pattern give the matches and what lies
between them; a fold over both gives their places in code points. Generators with high recall propose further, overlapping
spans (disguised addresses, long numbers, key-like strings); gradient-boosted trees over format and context features score
them, as a SQL expression, and thresholds calibrated per generator on a held-out half select. A selected span is added
unless it overlaps a base span; among each other, overlapping selected spans stand together.

The trees are trained on the driver, once per process, from PER_FORMAT drawn examples of each of a fixed list of formats;
no corpus row is used, so the bound is part of the definition.

Null texts count as empty and have no spans; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import let

KINDS = ["email", "ip", "card", "phone", "address", "number", "secret"]
# The look-behinds keep a search from starting again inside of a run that has failed; \G lets it start where a match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Generators: disguised addresses, numbers of seven digits or more, key-like strings.
AT = r"\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?"
ADDRESS = rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]++)++"
NUMBER = r"(?<![A-Za-z0-9.])(?:\([0-9]|[0-9])(?:[\x20().+/-]?[\x20().+/-]?[0-9])++"
SECRET = r"(?:(?<![A-Za-z0-9_/+=-])|\G)[A-Za-z0-9_/+=-]++"
PER_FORMAT, TREES, DEPTH, RATE, SEED = 120, 24, 3, 0.3, 7
#: Share of the selected held-out examples of a generator that must be personal data.
PRECISION = 0.99

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
CANDIDATE = "array<struct<start:bigint,kind:int,end:bigint,m:string,before:string,after:string>>"


def _fold(t: Column, pattern: str, kind: int, accept, wide: bool = False) -> Column:
    """The accepted matches of pattern in t, in order. Only accepted ones are kept, so the fold is linear in the matches."""
    empty = F.expr(f"cast(array() as {CANDIDATE if wide else SPAN})")
    start = F.struct(F.lit(0).cast("long").alias("pos"), empty.alias("out"))

    def step(parts: Column, found: Column):
        def one(acc: Column, i: Column) -> Column:
            m = F.get(found, i)
            begin = acc["pos"] + F.length(F.get(parts, i))
            end = begin + F.length(m)
            span = [begin.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end")]
            if wide:
                span += [m.alias("m"), F.substring(t, F.greatest(begin - 27, F.lit(1)).cast("int"), F.least(begin, F.lit(28)).cast("int")).alias("before"), F.left(F.get(parts, i + 1), F.lit(2)).alias("after")]
            return F.struct(end.cast("long").alias("pos"), F.when(accept(m), F.concat(acc["out"], F.array(F.struct(*span)))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, one)["out"]

    return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(let(F.split(t, pattern, -1), lambda parts: step(parts, found))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def base_spans(t: Column) -> Column:
    """The base spans of t by start, then kind."""
    none = F.expr(f"cast(array() as {SPAN})")
    card = lambda m: let(_digits(m), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    email = F.when(t.contains("@"), _fold(t, EMAIL, 0, lambda m: F.lit(True))).otherwise(none)
    ip = F.when(t.rlike(r"[0-9]\.[0-9]"), _fold(t, IP, 1, lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))).otherwise(none)
    cards = F.when(t.rlike("[0-9]"), _fold(t, CARD, 2, card)).otherwise(none)
    phone = F.when(t.contains("+"), _fold(t, PHONE, 3, lambda m: F.length(_digits(m)).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, cards, phone))


def candidates(t: Column) -> Column:
    none = F.expr(f"cast(array() as {CANDIDATE})")
    address = F.when(t.rlike(r"(?:at|AT)\x20?[\])]"), _fold(t, ADDRESS, 4, lambda m: F.lit(True), True)).otherwise(none)
    digits = t.rlike("[0-9]")
    number = F.when(digits, _fold(t, NUMBER, 5, lambda m: F.length(_digits(m)) >= 7, True)).otherwise(none)
    secret = F.when(digits, _fold(t, SECRET, 6, lambda m: (F.length(m) >= 16) & m.rlike("[0-9]") & m.rlike("[A-Za-z]"), True)).otherwise(none)
    return F.concat(address, number, secret)


def features(c: Column) -> Column:
    """Format and context features of a candidate, as an array of doubles."""
    m, before, d = c["m"], c["before"], _digits(c["m"])
    left = lambda chars: F.length(m) - F.length(F.regexp_replace(m, f"[{chars}]+", ""))
    said = lambda words: before.rlike(rf"(?i)(?:{words})")
    out = [
        c["kind"], F.length(m), F.length(d), left("A-Za-z"), left("A-Z"), left("^A-Za-z0-9"), F.size(F.array_distinct(F.split(m, ""))),
        F.call_function("luhn_check", d), m.rlike("^[0-9a-f]+$"), m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), m.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"),
        m.rlike(r"^[3-6][0-9]{3}(?:[\x20-]?[0-9]{4}){3}$"), m.rlike(r"^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}"), m.rlike(r"^[0-9]+(?:\.[0-9]+)+$"),
        said("token|key|secret|passw|auth|bearer|credential"), said("phone|tel\\b|tel[.:]|call|mobile|fax|contact"), said("card|visa|credit|account|iban|ssn|social|passport"), before.rlike("[=:\"']\\s?[\"']?$"),
        said("order|isbn|version|page|commit|sha|ref|invoice|part|serial|build|total|code"), c["after"].rlike("^[A-Za-z]"),
    ]
    return F.array(*[x.cast("double") for x in out])


def _examples() -> list[tuple[str, str, str, int]]:
    """(before, the span, after, 1 if personal data): PER_FORMAT draws of each format."""
    r = random.Random(SEED)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum, low = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: of(low, r.randint(2, 9))
    plain = lambda: f"{word()} {word()} "

    def luhn(d):
        s = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d))))
        return d + str(-s % 10)

    said = lambda *words: plain() + r.choice(words) + r.choice([" ", ": ", " = ", "=", ' = "', " is "])
    formats = [
        (1, lambda: (said("token", "api_key", "secret", "password", "auth key", "access token"), of(hexa, r.choice([32, 40, 40, 64])))),
        (1, lambda: (said("token", "key", "secret", "credential", "bearer"), of(alnum, r.randint(20, 48)))),
        (1, lambda: (plain() + r.choice(["", '"', "= "]), r.choice(["sk-", "ghp_", "AKIA", "xox-"]) + of(alnum, r.randint(20, 36)))),
        (1, lambda: (plain(), f"{n(3)}-{n(2)}-{n(4)}")),
        (1, lambda: (said("ssn", "social security"), f"{n(3)}-{n(2)}-{n(4)}")),
        (1, lambda: (plain(), r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}"]).format(n(3), n(3), n(4)))),
        (1, lambda: (said("phone", "tel.", "call", "mobile", "fax"), r.choice(["{} {} {}", "{}{}{}", "{}-{}-{}"]).format(n(3), n(3), n(4)))),
        (1, lambda: (said("card", "visa", "account", "credit card"), r.choice("3456") + n(15))),
        (1, lambda: (plain(), (lambda d: r.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4)))(luhn(r.choice("3456") + n(14))))),
        (1, lambda: (said("card", "visa", "credit card", "account"), luhn(r.choice("3456") + n(14)))),
        (1, lambda: (plain(), f"{word()}.{word()}{r.choice([' (at) ', '[at]', ' [at] ', '(at)'])}{word()}{r.choice(['.', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net'])}")),
        (0, lambda: (plain(), f"{r.randint(1900, 2030)}{(s := r.choice('-/.'))}{r.randint(1, 12):02}{s}{r.randint(1, 28):02}")),
        (0, lambda: (plain(), f"{r.randint(1, 28):02}{(s := r.choice('-/.'))}{r.randint(1, 12):02}{s}{r.randint(1900, 2030)}")),
        (0, lambda: (said("order", "invoice", "ref", "part", "serial", "build"), n(r.randint(7, 14)))),
        (0, lambda: (plain(), n(r.choice([7, 8, 9, 10, 11, 12, 13, 14])))),
        (0, lambda: (plain(), n(r.randint(15, 24)))),
        (0, lambda: (plain(), (lambda d: d[:-1] + str((int(d[-1]) + r.randint(1, 9)) % 10))(luhn(r.choice("3456") + n(14))))),
        (0, lambda: (plain(), f"{n(r.randint(1, 6))}.{n(r.randint(6, 12))}")),
        (0, lambda: (plain(), f"{n(2)}.{n(3)}.{n(2)}.{n(r.randint(1, 3))}")),
        (0, lambda: (said("version", "isbn", "code"), f"97{r.choice('89')}-{n(1)}-{n(4)}-{n(4)}-{n(1)}")),
        (0, lambda: (plain(), " ".join(n(r.randint(1, 3)) for _ in range(r.randint(5, 9))))),
        (0, lambda: (said("commit", "sha", "build"), of(hexa, 40))),
        (0, lambda: (plain(), "-".join(word() for _ in range(3)) + "-" + n(r.randint(1, 4)) + "-" + word() + word())),
        (0, lambda: (plain(), "/".join(word() for _ in range(4)) + "/" + n(2) + word())),
        (0, lambda: (plain(), word() + word() + word() + n(r.randint(1, 3)))),
        (0, lambda: (plain(), f"{word()} (at) {word()} {word()}")),
    ]
    return [(*make(), r.choice(["", " ", ".", '"', ", "]) + r.choice(["", word()]), label) for label, make in formats for _ in range(PER_FORMAT)]


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """(feature, threshold, left, right) or a leaf's value: exact greedy splits on the logistic loss."""
    if depth == 0 or len(g) < 20:
        return float(-g.sum() / (h.sum() + 1.0))
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + 1.0) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1.0) - whole
            if gain.max() > best[0]:
                k = at[gain.argmax()]
                best = (gain.max(), f, (v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return float(-g.sum() / (h.sum() + 1.0))
    left = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


_MODEL: list = []


def model(spark: SparkSession) -> tuple[list, dict[int, float]]:
    """The trees and the threshold of each generator. Examples pass the generators and features as SQL, like any text."""
    if not _MODEL:
        rows = [(i, b + s + a, len(b), len(b) + len(s), y) for i, (b, s, a, y) in enumerate(_examples())]
        made = spark.createDataFrame(rows, "id int, t string, s long, e long, y int").select("*", F.explode(candidates(F.col("t"))).alias("c"))
        rows = made.where("c.start < e and s < c.end").select("id", F.when((F.col("c.start") <= F.col("s") + 1) & (F.col("c.end") >= F.col("e") - 1), F.col("y")).otherwise(0).alias("y"), features(F.col("c")).alias("f")).collect()
        rows.sort(key=lambda r: (r["id"], r["f"]))
        x, y, half = np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["id"] % 2 for r in rows])
        trees, score = [], np.zeros(len(y))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            trees.append(_tree(x[half == 0], g[half == 0], h[half == 0], DEPTH))
            score += RATE * _value(trees[-1], x)
        limits = {}
        for kind in (4, 5, 6):
            at = (half == 1) & (x[:, 0] == kind)
            order = np.argsort(-score[at], kind="stable")
            s, good = score[at][order], np.cumsum(y[at][order]) / np.arange(1, at.sum() + 1)
            ok = np.flatnonzero((good >= PRECISION) & np.r_[s[1:] < s[:-1], True])
            # halfway to the next score below, or just below the last, and never for what is likelier not to be personal data
            limits[kind] = max(0.0, float((s[ok[-1]] + (s[ok[-1] + 1] if ok[-1] + 1 < len(s) else s[ok[-1]])) / 2) - 1e-9) if len(ok) else float("inf")
        _MODEL.append((trees, limits))
    return _MODEL[0]


def _sql(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(F.get(f, F.lit(tree[0])) <= tree[1], _sql(tree[2], f)).otherwise(_sql(tree[3], f))


def added_spans(t: Column, base: Column, trees: list, limits: dict[int, float]) -> Column:
    """The selected candidates of t that overlap no base span."""
    score = lambda f: sum((RATE * _sql(tree, f) for tree in trees), F.lit(0.0))
    limit = lambda c: F.when(c["kind"] == 4, limits[4]).when(c["kind"] == 5, limits[5]).otherwise(limits[6])
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    good = F.filter(candidates(t), lambda c: free(c) & (let(features(c), score) >= limit(c)))
    return F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def found(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """docs with the arrays `base` and `spans` of (start, kind, end): code points, end exclusive, by start, kind, end."""
    trees, limits = model(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.expr(f"cast(array() as {SPAN})")

    def both(x: Column) -> Column:
        full = let(base_spans(x), lambda b: F.struct(b.alias("b"), F.array_sort(F.concat(b, added_spans(x, b, trees, limits))).alias("s")))
        return F.when(x.rlike(r"[0-9@\])]"), full).otherwise(F.struct(none.alias("b"), none.alias("s")))

    at = "__found"
    while at in docs.columns:
        at += "_"
    inner = docs.drop(base, spans).withColumn(at, let(t, both))
    return inner.select(*[F.col(f"`{c}`") for c in inner.columns if c != at], F.col(at)["b"].alias(base), F.col(at)["s"].alias(spans))


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["out"], F.array(F.substring(text, acc["pos"].cast("int") + 1, (s["start"] - acc["pos"]).cast("int")), F.get(kinds, s["kind"])))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], cut).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<string>)").alias("out"))
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"].cast("int") + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, done))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the personal data in text replaced; null texts stay null, and so do all other columns."""
    s, b = "__spans", "__base"
    while s in docs.columns or b in docs.columns:
        s, b = s + "_", b + "_"
    marked = found(docs, text, b, s)
    return marked.select(*[redacted(F.col(f"`{c}`"), F.col(s)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
