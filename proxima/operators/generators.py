"""R: synthetic point sets and report tables. Every row is drawn from hashes of its number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import normal, uniform
from .ranks import ranked

TAU = 6.283185307179586
#: Centre and spread of the five Gaussian groups of R1, by label.
SHAPES = {1: (0.0, 0.0, 1.2, 1.2), 2: (8.0, 1.5, 1.4, 0.4), 3: (8.0, -1.5, 1.4, 0.4), 4: (3.5, 6.0, 0.5, 0.5), 5: (6.0, 6.0, 0.5, 0.5)}


def cure(spark: SparkSession, per: int = 2000, seed: int = 1) -> DataFrame:
    """(id, x, y, label): five Gaussian groups, a uniform bridge (6) and uniform noise (7), `per` points of each."""
    i = spark.range(7 * per).withColumn("label", (F.floor(F.col("id") / per) + 1).cast("int"))

    def coordinate(n: int) -> Column:
        g = normal(F.col("id"), seed, n)
        out = F.when(F.col("label") == 6, (4.0 + 1.5 * uniform(F.col("id"), seed, "u", n)) if n == 0 else 5.9 + 0.2 * uniform(F.col("id"), seed, "u", n))
        for k, s in SHAPES.items():
            out = out.when(F.col("label") == k, s[n] + s[2 + n] * g)
        return out.otherwise((-4.0 + 16.0 * uniform(F.col("id"), seed, "u", n)) if n == 0 else -4.0 + 12.0 * uniform(F.col("id"), seed, "u", n))
    return i.select("id", coordinate(0).alias("x"), coordinate(1).alias("y"), "label")


def _standardised(df: DataFrame) -> DataFrame:
    m = df.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return df.crossJoin(F.broadcast(m)).select("id", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in "xy"], "label")


def circles(spark: SparkSession, n: int = 10_000, factor: float = 0.5, noise: float = 0.05, seed: int = 1) -> DataFrame:
    """R2: two rings, standardised."""
    a, r = uniform(F.col("id"), seed) * TAU, F.when(F.col("label") == 1, factor).otherwise(1.0)
    df = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int"))
    return _standardised(df.select("id", (r * F.cos(a) + noise * normal(F.col("id"), seed, "x")).alias("x"), (r * F.sin(a) + noise * normal(F.col("id"), seed, "y")).alias("y"), "label"))


def moons(spark: SparkSession, n: int = 10_000, noise: float = 0.05, seed: int = 1) -> DataFrame:
    """R2: two half rings, standardised."""
    a = uniform(F.col("id"), seed) * TAU / 2
    x, y = F.when(F.col("label") == 1, 1 - F.cos(a)).otherwise(F.cos(a)), F.when(F.col("label") == 1, 0.5 - F.sin(a)).otherwise(F.sin(a))
    df = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int"))
    return _standardised(df.select("id", (x + noise * normal(F.col("id"), seed, "x")).alias("x"), (y + noise * normal(F.col("id"), seed, "y")).alias("y"), "label"))


def jitter(points: DataFrame, spread: float, seed: int = 1) -> DataFrame:
    """points(id, v) with Gaussian noise on every component."""
    return points.withColumn("v", F.transform("v", lambda x, n: x + spread * normal(F.col("id"), n, seed)))


def metric_pivot(grid: DataFrame, metric: str, minpts: list[int]) -> DataFrame:
    """One row per eps, one column per minpts, zero where missing."""
    return grid.groupBy("eps").pivot("minpts", minpts).agg(F.first(metric)).na.fill(0)


def report(df: DataFrame, style: str = "markdown") -> DataFrame:
    """(row, line) of a result table, values to four decimals; row 0 is the head. Rows are in the order of the first column."""
    left, mid, right = {"markdown": ("| ", " | ", " |"), "latex": ("", " & ", r" \\")}[style]
    shown = [F.when(F.col(f"`{f.name}`").isNotNull(), F.format_string("%.4f", F.col(f"`{f.name}`").cast("double"))) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`").cast("string") for f in df.schema]
    body = ranked(df.select(F.col(f"`{df.columns[0]}`").alias("first"), F.concat(F.lit(left), F.concat_ws(mid, *[F.coalesce(c, F.lit("")) for c in shown]), F.lit(right)).alias("line")), ["first", "line"], "row").select(F.col("row").cast("int").alias("row"), "line")
    return df.sparkSession.createDataFrame([(0, left + mid.join(df.columns) + right)], "row int, line string").unionByName(body)
