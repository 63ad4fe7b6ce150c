"""M: quality of clusterings. Inputs are pairs(pred, truth); everything rests on the contingency table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .similarity import top_k


def contingency(pairs: DataFrame) -> DataFrame:
    """M1: (pred, truth, n)."""
    return pairs.groupBy("pred", "truth").agg(F.count("*").alias("n"))


def _margins(c: DataFrame) -> DataFrame:
    p, t = c.groupBy("pred").agg(F.sum("n").alias("np")), c.groupBy("truth").agg(F.sum("n").alias("nt"))
    total = c.agg(F.sum("n").alias("all"))
    return c.join(p, "pred").join(t, "truth").crossJoin(F.broadcast(total))


def purity_entropy(pairs: DataFrame, smoothing: float = 1e-10) -> DataFrame:
    """M2, M3: one row (purity, entropy). Entropy is weighted by size and divided by ln of the number of classes; null for one class."""
    m = _margins(contingency(pairs))
    per = m.groupBy("pred").agg(F.max("n").alias("top"), (-F.sum(F.col("n") / F.col("np") * F.log(F.col("n") / F.col("np") + smoothing))).alias("h"), F.first("np").alias("np"), F.first("all").alias("all"))
    classes = pairs.agg(F.countDistinct("truth").alias("classes"))
    out = per.agg((F.sum("top") / F.first("all")).alias("purity"), F.sum(F.col("np") / F.col("all") * F.col("h")).alias("h"))
    return out.crossJoin(classes).select("purity", F.when(F.col("classes") > 1, F.col("h") / F.log("classes")).alias("entropy"))


def _pairs2(c):
    return c * (c - 1) / 2


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """M4: one row (ari)."""
    c = contingency(pairs)
    ij = c.agg(F.sum(_pairs2(F.col("n"))).alias("ij"), F.sum("n").alias("all"))
    a = c.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(_pairs2(F.col("n"))).alias("a"))
    b = c.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(_pairs2(F.col("n"))).alias("b"))
    e = F.col("a") * F.col("b") / _pairs2(F.col("all"))
    top = (F.col("a") + F.col("b")) / 2
    return ij.crossJoin(a).crossJoin(b).select(F.when(top == e, 1.0).otherwise((F.col("ij") - e) / (top - e)).alias("ari"))


def information(pairs: DataFrame) -> DataFrame:
    """One row (mi, h_pred, h_truth), natural logarithms."""
    m = _margins(contingency(pairs))
    mi = m.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("np") * F.col("nt")))).alias("mi"))

    def entropy(by: str, size: str, name: str) -> DataFrame:
        g = m.select(by, size, "all").distinct()
        return g.agg((-F.sum(F.col(size) / F.col("all") * F.log(F.col(size) / F.col("all")))).alias(name))

    return mi.crossJoin(entropy("pred", "np", "h_pred")).crossJoin(entropy("truth", "nt", "h_truth"))


def homogeneity_completeness_v(pairs: DataFrame) -> DataFrame:
    """M5: one row (homogeneity, completeness, v_measure)."""
    h = F.when(F.col("h_truth") == 0, 1.0).otherwise(F.col("mi") / F.col("h_truth"))
    c = F.when(F.col("h_pred") == 0, 1.0).otherwise(F.col("mi") / F.col("h_pred"))
    return information(pairs).select(h.alias("homogeneity"), c.alias("completeness"), F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)).alias("v_measure"))


def nmi(pairs: DataFrame) -> DataFrame:
    """M6: one row (nmi_arithmetic, nmi_geometric)."""
    a, g = (F.col("h_pred") + F.col("h_truth")) / 2, F.sqrt(F.col("h_pred") * F.col("h_truth"))
    return information(pairs).select(F.when(a == 0, 1.0).otherwise(F.col("mi") / a).alias("nmi_arithmetic"), F.when(g == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(F.col("mi") / g).alias("nmi_geometric"))


def _log_factorial(n: Column) -> Column:
    """ln n! of whole numbers: products below 16, Stirling's series from there on (its error is below 1e-15)."""
    few, x = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < 16, F.element_at(few, n.cast("int") + 1)).otherwise(series)


def expected_information(pairs: DataFrame) -> DataFrame:
    """One row (emi) under the hypergeometric model.

    Clusters are grouped by size first, which leaves fewer than sqrt(2 N) sizes on either side. Of the counts that two sizes may
    share, those further than 8 sqrt(min(a, b)) from the mean are left out: by Hoeffding's bound their share is below 1e-54.
    """
    c = contingency(pairs)
    a = c.groupBy("pred").agg(F.sum("n").alias("a")).groupBy("a").agg(F.count("*").alias("ka"))
    b = c.groupBy("truth").agg(F.sum("n").alias("b")).groupBy("b").agg(F.count("*").alias("kb"))
    total = int(c.agg(F.sum("n")).first()[0] or 0)
    n = F.lit(total).cast("long")
    mean, reach = F.col("a") * F.col("b") / F.greatest(n, F.lit(1)), 8 * F.sqrt(F.least("a", "b")) + 1
    low, high = F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - n, F.floor(mean - reach)), F.least(F.col("a"), F.col("b"), F.ceil(mean + reach))
    cells = a.crossJoin(b).withColumns({"low": low, "high": high}).where("low <= high").withColumn("n", F.explode(F.sequence("low", "high")))
    lf = lambda x: _log_factorial(x if isinstance(x, Column) else F.col(x))
    p = F.exp(lf("a") + lf("b") + lf(n - F.col("a")) + lf(n - F.col("b")) - lf(n) - lf("n") - lf(F.col("a") - F.col("n")) - lf(F.col("b") - F.col("n")) - lf(n - F.col("a") - F.col("b") + F.col("n")))
    return cells.agg(F.coalesce(F.sum(F.col("ka") * F.col("kb") * F.col("n") / n * F.log(n.cast("double") * F.col("n") / (F.col("a").cast("double") * F.col("b"))) * p), F.lit(0.0)).alias("emi"))


def ami(pairs: DataFrame) -> DataFrame:
    """M6: one row (ami), arithmetic normalisation."""
    top = (F.col("h_pred") + F.col("h_truth")) / 2
    return information(pairs).crossJoin(expected_information(pairs)).select(F.when(top == F.col("emi"), 1.0).otherwise((F.col("mi") - F.col("emi")) / (top - F.col("emi"))).alias("ami"))


def scores(pairs: DataFrame) -> DataFrame:
    """M1: the bundle (E, P, ARI, AMI, NMI, H, C, VM) in one row."""
    pe, hcv = purity_entropy(pairs), homogeneity_completeness_v(pairs)
    out = pe.select(F.col("entropy").alias("E"), F.col("purity").alias("P")).crossJoin(adjusted_rand(pairs).toDF("ARI")).crossJoin(ami(pairs).toDF("AMI")).crossJoin(nmi(pairs).select(F.col("nmi_geometric").alias("NMI")))
    return out.crossJoin(hcv.toDF("H", "C", "VM"))


def without_noise(pairs: DataFrame) -> DataFrame:
    """M7: pairs whose prediction is not noise."""
    return pairs.where(F.col("pred") != -1)


def confusion(pairs: DataFrame, classes: list) -> DataFrame:
    """M7: one row per prediction, one column per class given, zero where nothing meets."""
    return pairs.groupBy("pred").pivot("truth", classes).count().na.fill(0)


def snn_distance_or(snn_: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(i, j, d), d = k - w, between labelled points that share a neighbour; all other pairs are at distance k."""
    own = labels.select(F.col("id").alias("i"))
    return snn_.join(own, "i", "left_semi").join(own.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", (F.lit(float(k)) - F.col("w")).alias("d"))


def silhouette(labels: DataFrame, distances: DataFrame, missing: float) -> DataFrame:
    """M8: one row (silhouette): mean over points. distances(i, j, d) lists what is nearer than `missing`, the distance of all
    other pairs, so no absent pair is built: a cluster that a point has no listed pair with is at `missing`, whichever it is.
    NaN for a single cluster or a lone point."""
    size = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    others = F.col("size") - F.when(F.col("cluster") == F.col("own"), 1).otherwise(0)
    near = distances.join(labels.select(F.col("id").alias("j"), "cluster"), "j").groupBy(F.col("i").alias("id"), "cluster").agg(F.sum("d").alias("sum"), F.count("*").alias("n"))
    own = labels.select("id", F.col("cluster").alias("own"))
    mean = (F.col("sum") + missing * (others - F.col("n"))) / others
    met = near.join(own, "id").join(size, "cluster").withColumn("mean", mean).groupBy("id").agg(F.max(F.when(F.col("cluster") == F.col("own"), F.col("mean"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("own"), F.col("mean"))).alias("b"), F.sum(F.when(F.col("cluster") != F.col("own"), 1).otherwise(0)).alias("met"))
    per = own.join(met, "id", "left").join(size.withColumnRenamed("cluster", "own"), "own").crossJoin(F.broadcast(size.agg(F.count("*").alias("clusters"))))
    a = F.when(F.col("size") == 1, float("nan")).otherwise(F.coalesce("a", F.lit(float(missing))))
    b = F.least(F.col("b"), F.when(F.coalesce("met", F.lit(0)) < F.col("clusters") - 1, F.lit(float(missing))))
    s = per.select(a.alias("a"), b.alias("b")).select(F.when(F.col("b").isNull(), float("nan")).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    return s.agg(F.avg("s").alias("silhouette"))


def cvnn(labels: DataFrame, distances: DataFrame, missing: float, k: int = 10) -> DataFrame:
    """M9: one row (compactness, separation, cvnn): mean distance inside clusters, summed; and the largest share of foreign points
    among the k nearest of a cluster's points. Pairs that are not listed are at `missing`; of them none counts as near."""
    ci, cj = labels.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), labels.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    d = distances.join(ci, "i").join(cj, "j")
    size = labels.groupBy(F.col("cluster").alias("ci")).agg(F.count("*").alias("size"))
    inner = size.join(d.where("ci = cj").groupBy("ci").agg(F.sum("d").alias("sum"), F.count("*").alias("n")), "ci", "left")
    pairs = F.col("size") * (F.col("size") - 1)
    compact = F.when(pairs > 0, (F.coalesce("sum", F.lit(0.0)) + missing * (pairs - F.coalesce("n", F.lit(0)))) / pairs).otherwise(0.0)
    near = top_k(d.withColumn("s", -F.col("d")), k)
    apart = near.groupBy("i", "ci").agg(F.sum(F.when(F.col("ci") != F.col("cj"), 1).otherwise(0)).alias("foreign")).groupBy("ci").agg(F.sum(F.col("foreign") / k).alias("f"))
    per = inner.join(apart, "ci", "left").select(compact.alias("c"), (F.coalesce("f", F.lit(0.0)) / F.col("size")).alias("s"))
    return per.agg(F.sum("c").alias("compactness"), F.max("s").alias("separation")).withColumn("cvnn", F.col("compactness") + F.col("separation"))


def size_score(pairs: DataFrame) -> DataFrame:
    """One row (score) = 2p(2-e)/(p+2-e), p the purity and e the entropy (bits) of the predicted sizes."""
    p = purity_entropy(pairs).select(F.col("purity").alias("p"))
    sizes = pairs.groupBy("pred").agg(F.count("*").alias("n"))
    e = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all")))).agg((-F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") / F.col("all")))).alias("e"))
    return p.crossJoin(e).select((2 * F.col("p") * (2 - F.col("e")) / (F.col("p") + 2 - F.col("e"))).alias("score"))


def kind_counts(assign: DataFrame) -> DataFrame:
    """(kind, points, clusters)."""
    return assign.groupBy("kind").agg(F.count("*").alias("points"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"))


def mean_std(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """M12."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def histogram(snn_: DataFrame) -> DataFrame:
    """(w, n, ecdf) of shared-neighbour counts; the distinct counts are few."""
    h = snn_.groupBy("w").agg(F.count("*").alias("n"))
    run = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    return h.crossJoin(F.broadcast(h.agg(F.sum("n").alias("all")))).select("w", "n", (F.sum("n").over(run) / F.col("all")).alias("ecdf"))


def quartiles(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """M14."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return runs.groupBy(*by).agg(q.alias("q")).select(*by, *[F.col("q")[n].alias(name) for n, name in enumerate(("q1", "median", "q3"))])


def encode_labels(df: DataFrame, order: str, label: str) -> DataFrame:
    """Df with code, 1..C by first appearance in `order`."""
    firsts = df.groupBy(label).agg(F.min(order).alias("__first"))
    # labels that begin at one place share a code: the places are ranked
    codes = ranked(firsts.select("__first").distinct(), ["__first"], "code")
    return df.join(firsts.join(codes, "__first").select(label, F.col("code").cast("int").alias("code")), label)
