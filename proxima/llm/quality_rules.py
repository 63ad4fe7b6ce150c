"""Quality rules: base statistics of texts, and robust multivariate outliers per language and source.

Everything here is DataFrame functions. Texts become a few counts each; the counts, transformed, are vectors whose
location and scatter are estimated per (lang, source) by the minimum covariance determinant: three starts (median absolute
deviations; the scatter of the values' hyperbolic tangents; that of their spatial signs), concentration steps, each keeping the
H share of rows nearest to the estimate, and of the starts the one with the least determinant, which goes on until its
determinant falls no further. Quantiles come from fixed-width histograms, so they add up the same on any number of machines.
Groups with fewer than LEAST rows, which are too few for a scatter of seven numbers, share one estimate per language; where that
is too small as well nothing is known and nothing is rejected.

Null texts count as empty texts (and so fail the base rule); null languages and sources are groups like any others;
repeated rows count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
#: The transformed statistics, with the deviation that counts as noise in each (it bounds the variance from below).
FLOORS = {"z0": 0.06, "z1": 0.04, "z2": 0.06, "z3": 0.04, "z4": 0.06, "z5": 0.06, "z6": 0.5}
Z = list(FLOORS)
#: Share of rows that the estimates rest on, steps of every start, fall of the log determinant that ends the best one's, steps at
#: most, least rows of a group.
H, STEPS, FALL, MOST, LEAST = 0.75, 2, 0.02, 10, 60
STARTS = 3
#: Bins of a doubling in histograms of distances.
BINS = 256
#: Squared distance at which a vector is rejected: the chi-square quantile of 7 degrees at 1 - 1e-9.
CUTOFF = 58.0
#: The median of the chi-square distribution with 7 degrees.
MEDIAN_7 = 6.346
#: Most groups whose estimates are broadcast (some 400 bytes each); beyond, they are joined by shuffling.
BROADCAST_GROUPS = 20_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the array holds twice or more. Sorts window hashes: n log n, whatever repeats."""

    def covered(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(marked(h)))

    def marked(h: Column) -> Column:
        # up to 65,536 windows 48 bits of the hash and the place make one number; whole hashes beyond
        return let(F.when(F.size(h) <= 65_536, by_numbers(h)).otherwise(by_hashes(h)), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x))

    def beside(k: Column, j: Column, same) -> Column:
        return F.coalesce(same(F.get(k, j + 1)), F.lit(False)) | F.coalesce(same(F.get(k, F.when(j > 0, j - 1).otherwise(F.lit(-1)))), F.lit(False))

    def by_numbers(h: Column) -> Column:
        mask = F.lit(65_535).cast("long")
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~65_535).cast("long")).bitwiseOR(i.cast("long"))))
        at = lambda x: F.get(h, x.bitwiseAND(mask).cast("int"))
        return let(keys, lambda k: F.sort_array(F.transform(F.filter(k, lambda x, j: beside(k, j, lambda y: at(x) == at(y))), lambda x: x.bitwiseAND(mask))))

    def by_hashes(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return let(keys, lambda k: F.sort_array(F.transform(F.filter(k, lambda x, j: beside(k, j, lambda y: x["h"] == y["h"])), lambda x: x["i"])))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(covered(w)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_upper and n_marks for the vectors."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = lambda t, chars: F.length(F.regexp_replace(t, f"[^{chars}]+", "")).cast("long")

    def counts(t: Column) -> Column:
        words = F.array_remove(F.split(t, SPACE), "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        own = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
        return F.struct(own.alias("w"), found(t, r"#*$%&|<>").alias("n_symbols"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), found(t, r"\p{Lu}").alias("n_upper"), found(t, r"!?;:()").alias("n_marks"))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    inner = docs.drop(*names, "n_upper", "n_marks")
    at = "__counts"
    while at in inner.columns:
        at += "_"
    s = inner.withColumn(at, let(body, counts))
    c = F.col(at)
    return s.select(*[F.col(f"`{x}`") for x in inner.columns], *[(c["w"][n] if n in ("n_words", "word_chars", "n_repeat_words") else c[n]).alias(n) for n in names], c["n_upper"].alias("n_upper"), c["n_marks"].alias("n_marks"))


def vectors() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    exprs = [F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.col("n_repeat_words") / n, F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_upper") / chars), F.sqrt(F.col("n_marks") / chars), F.log(n)]
    return dict(zip(Z, exprs))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _with(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """rows joined with the estimates of their group g; broadcast only up to a checked number of groups."""
    return rows.join(F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates, "g")


def _quantile(bins: DataFrame, by: list[str], share: float) -> DataFrame:
    """Per key of `by`, the least bin at which that share of the counts n is reached. The bins of a key are few."""
    w = Window.partitionBy(*by).orderBy("bin")
    return bins.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(*by))}).where(F.col("upto") >= share * F.col("all")).groupBy(*by).agg(F.min("bin").alias("bin"))


def _medians(rows: DataFrame, values: dict[str, Column], width: float = 1 / 256) -> DataFrame:
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.floor(v / width).alias("bin")) for z, v in values.items()])).alias("x")).select("g", "x.*")
    q = _quantile(long.groupBy("g", "z", "bin").agg(F.count("*").alias("n")), ["g", "z"], 0.5)
    return q.groupBy("g").agg(*[F.max(F.when(F.col("z") == z, (F.col("bin") + 0.5) * width)).alias(z) for z in values])


def _pairs():
    return [(i, j) for i in range(len(Z)) for j in range(i, len(Z))]


def _inverted(m: DataFrame) -> DataFrame:
    """Rows with the upper triangle a_i_j of a matrix: with that of its inverse and logdet, by the sweep operator on an array."""
    n, keep = len(Z), [c for c in m.columns if not c.startswith("a_")]

    def swept(state: Column, k: int) -> Column:
        def by_pivot(p: Column, s: Column) -> Column:
            def cell(x: Column, t: Column) -> Column:
                i, j = F.floor(t / n), t % n
                rest = x - F.get(s["a"], (i * n + k).cast("int")) * F.get(s["a"], (j + k * n).cast("int")) / p
                return F.when((i == k) & (j == k), -1 / p).when((i == k) | (j == k), x / p).otherwise(rest)

            return F.struct(F.transform(s["a"], cell).alias("a"), (s["d"] + F.log(p)).alias("d"))

        return let(state, lambda s: let(F.get(s["a"], F.lit(k * n + k)), lambda p: by_pivot(p, s)))

    state = F.struct(F.array(*[F.col(f"a_{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)]).alias("a"), F.lit(0.0).alias("d"))
    for k in range(n):
        state = swept(state, k)
    done = m.select(*keep, state.alias("swept"))
    return done.select(*keep, F.col("swept.d").alias("logdet"), *[(-F.get("swept.a", F.lit(i * n + j))).alias(f"a_{i}_{j}") for i, j in _pairs()])


def _distance() -> Column:
    d = [F.col(z) - F.col(f"m_{z}") for z in Z]
    return F.col("scale") * sum((F.col(f"a_{i}_{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in _pairs()), F.lit(0.0))


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(0.0)) + 1e-6) * BINS)


def _starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """For every group g the estimates (g#0, ...) that concentration begins from, and the number of groups."""
    med = cut(_medians(rows, {z: F.col(z) for z in Z}).toDF("g", *[f"m_{z}" for z in Z]))
    groups = med.count()
    mad = _medians(_with(rows, med, groups), {z: F.abs(F.col(z) - F.col(f"m_{z}")) for z in Z})
    est = cut(med.join(mad.select("g", *[F.greatest(F.col(z) * 1.4826, F.lit(FLOORS[z])).alias(f"s_{z}") for z in Z]), "g"))
    at = _with(rows, est, groups).select("g", *[((F.col(z) - F.col(f"m_{z}")) / F.col(f"s_{z}")).alias(z) for z in Z])
    length = F.sqrt(sum((F.col(z) * F.col(z) for z in Z), F.lit(1e-12)))
    maps = {1: lambda z: F.tanh(z), 2: lambda z: F.col(z) / length}
    sums = at.groupBy("g").agg(*[F.avg(f(Z[i]) * f(Z[j])).alias(f"p{k}_{i}_{j}") for k, f in maps.items() for i, j in _pairs()])
    both, out = cut(est.join(sums, "g")), None
    for k in range(STARTS):
        # on the scale of the deviations; a tenth of a unit matrix keeps the few numbers that all agree apart
        c = lambda i, j: F.lit(float(i == j)) if not k else F.col(f"p{k}_{i}_{j}") + (0.1 if i == j else 0.0)  # noqa: B023, E731
        own = both.select(F.concat("g", F.lit(f"#{k}")).alias("g"), *[f"m_{z}" for z in Z], F.lit(1.0).alias("scale"), *[(c(i, j) * F.col(f"s_{Z[i]}") * F.col(f"s_{Z[j]}")).alias(f"a_{i}_{j}") for i, j in _pairs()])
        out = own if out is None else out.unionByName(own)
    return cut(_inverted(out)), groups


def _concentrated(rows: DataFrame, est: DataFrame, groups: int) -> DataFrame:
    """Location, inverse scatter and its log determinant of the H share of each group's rows that are nearest to the estimate."""
    at = _with(rows, est, groups).select("g", *Z, _bin(_distance()).alias("b"))
    near = _quantile(at.groupBy("g", F.col("b").alias("bin")).agg(F.count("*").alias("n")), ["g"], H)
    core = _with(at, near, groups).where("b <= bin")
    sums = core.groupBy("g").agg(*[F.avg(z).alias(f"m_{z}") for z in Z], *[F.avg(F.col(Z[i]) * F.col(Z[j])).alias(f"p_{i}_{j}") for i, j in _pairs()])
    cov = sums.select("g", *[f"m_{z}" for z in Z], F.lit(1.0).alias("scale"), *[(F.col(f"p_{i}_{j}") - F.col(f"m_{Z[i]}") * F.col(f"m_{Z[j]}") + (FLOORS[Z[i]] ** 2 if i == j else 0.0)).alias(f"a_{i}_{j}") for i, j in _pairs()])
    return _inverted(cov)


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """Location m_z, inverse scatter a_i_j, logdet and scale per group g of rows(g, z0, ...), and the number of groups."""
    est, groups = _starts(rows)
    every = rows.select(F.explode(F.array(*[F.concat("g", F.lit(f"#{k}")) for k in range(STARTS)])).alias("g"), *Z)
    for _ in range(STEPS):
        est = cut(_concentrated(every, est, groups * STARTS))
    columns = [c for c in est.columns if c != "g"]
    # ties, up to rounding, go to the first start
    best = est.groupBy(F.expr("left(g, length(g) - 2)").alias("g")).agg(F.min(F.struct(F.round("logdet", 6).alias("d"), F.right("g", F.lit(1)).alias("k"), F.struct(*columns).alias("e"))).alias("m"))
    est = cut(best.select("g", "m.e.*"))
    for _ in range(MOST):
        new = _concentrated(rows, est, groups)
        # a group whose determinant would rise keeps the estimate that it has
        both = new.select("g", F.struct(*columns).alias("new")).join(est.select("g", F.struct(*columns).alias("old")), "g")
        falls = F.col("old.logdet") - F.col("new.logdet")
        chosen = cut(both.select("g", F.when(falls > 0, F.col("new")).otherwise(F.col("old")).alias("e"), F.greatest(falls, F.lit(0.0)).alias("fall")))
        est = chosen.select("g", "e.*")
        if (chosen.agg(F.max("fall")).first()[0] or 0) <= FALL:
            break
    # the core's scatter is too small for all rows: distances are scaled to the median they have for normal data, downwards only
    mid = _quantile(_with(rows, est, groups).select("g", _bin(_distance()).alias("bin")).groupBy("g", "bin").agg(F.count("*").alias("n")), ["g"], 0.5)
    scaled = est.join(mid.select("g", F.least(F.lit(1.0), MEDIAN_7 / F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS)).alias("by")), "g")
    return cut(scaled.withColumn("scale", F.col("by")).drop("by")), groups


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] = ()) -> DataFrame:
    """Per row of docs: the columns `keep`, the base counts, base_failed, distance (null: not estimated) and kept."""
    names = [f"k{i}" for i in range(len(keep))]
    have = lambda c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string")
    raw = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], have(text).alias("text"), have(lang).alias("lang"), have(source).alias("source"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    s = statistics(raw).select(*names, "lang", "source", *counts, "n_upper", "n_marks")
    s = cut(s.withColumns({"base_failed": base_failed(), **vectors()}).drop("n_upper", "n_marks"))
    name = lambda *c: F.to_json(F.array(*[F.col(x) for x in c]))
    sizes = cut(s.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n")))
    sizes = sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.when(F.col("n") >= LEAST, name("lang", "source")).otherwise(name("lang")).alias("g"), "n")
    large = sizes.groupBy("g").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST)
    named = cut(sizes.join(large, "g").select("l", "s", "g"))
    small = F.broadcast(named) if named.count() <= BROADCAST_GROUPS else named
    s = s.join(small, s["lang"].eqNullSafe(small["l"]) & s["source"].eqNullSafe(small["s"]), "left").drop("l", "s")
    est, groups = estimates(s.where("not base_failed and g is not null").select("g", *Z))
    est = est.drop("logdet").withColumn("known", F.lit(True))
    s = s.join(F.broadcast(est) if groups <= BROADCAST_GROUPS else est, "g", "left").withColumn("distance", F.when(F.col("known") & ~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return s.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *counts, "base_failed", "distance", kept.alias("kept"))


def kept(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the rules keep. A verdict depends on text, language and source only, so it is joined by id and their hash."""
    key = lambda: F.xxhash64(*[F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit("") for c in (text, lang, source)])
    h = "__h"
    while h in docs.columns:
        h += "_"
    hashed = docs.withColumn(h, key())
    good = judged(hashed, text, lang, source, keep=[doc_id, h]).where("kept").select(F.col(doc_id).alias("__id"), F.col(h).alias("__key")).distinct()
    return hashed.join(good, hashed[doc_id].eqNullSafe(good["__id"]) & (hashed[h] == good["__key"]), "left_semi").drop(h)
