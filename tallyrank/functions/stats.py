"""Paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import avg_rank


def wilcoxon(df: DataFrame, groups: list[str], diff: str) -> DataFrame:
    """(groups, n, w_plus, w_minus, z): signed ranks of the non-zero differences, z with tie correction."""
    d = df.where((F.col(diff) != 0) & F.col(diff).isNotNull()).withColumn("__a", F.abs(diff))
    r = d.withColumn("__r", avg_rank("__a", *groups, descending=False)).withColumn("__t", F.count("*").over(Window.partitionBy(*groups, "__a")))
    out = r.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col(diff) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(diff) < 0, F.col("__r")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("__t") * F.col("__t") - 1).alias("ties"),
    )
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return out.select(*groups, "n", "w_plus", "w_minus", F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4.0) / F.sqrt(var)).alias("z"))


#: Differences up to which the exact distribution of the rank sum is taken.
EXACT = 25


def wilcoxon_exact(df: DataFrame, groups: list[str], diff: str, most: int = EXACT) -> DataFrame:
    """(groups, n, p_exact): two-sided p of the signed ranks of the non-zero differences, null for more than ``most``.

    The chance of a rank sum over all choices of signs, by a programme over twice the ranks (whole
    numbers even with ties): an array of counts of choices, to which each rank adds itself moved.
    """
    d = df.where((F.col(diff) != 0) & F.col(diff).isNotNull()).withColumn("__a", F.abs(diff))
    sizes = F.count("*").over(Window.partitionBy(*groups))
    r = d.withColumn("__n", sizes).where(F.col("__n") <= most).withColumn("__r", (2 * avg_rank("__a", *groups, descending=False)).cast("int"))
    own = r.groupBy(*groups).agg(F.collect_list("__r").alias("r"), F.sum(F.when(F.col(diff) > 0, F.col("__r")).otherwise(0)).alias("w"))  # ``most`` ranks
    total = F.aggregate("r", F.lit(0), lambda a, x: a + x)
    none = F.transform(F.sequence(F.lit(0), total), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate("r", none, lambda a, x: F.transform(a, lambda n, i: n + F.when(i >= x, F.get(a, i - x)).otherwise(0.0)))
    tail = F.aggregate(F.slice(F.col("ways"), 1, F.least(F.col("w"), F.col("total") - F.col("w")) + 1), F.lit(0.0), lambda a, x: a + x)
    p = own.select(*groups, "r", F.col("w").cast("int").alias("w"), total.alias("total"), ways.alias("ways")).select(*groups, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), F.size("r"))).alias("p_exact"))
    return d.groupBy(*groups).agg(F.count("*").alias("n")).join(p, groups, "left")


def holm(df: DataFrame, p: str, monotone: bool = True, key: str | None = None) -> DataFrame:
    """Adds ``p_holm`` to a table of tests; ``monotone`` takes the running maximum, as the procedure does."""
    w = Window.orderBy(p, *([key] if key else []))  # a row per test
    step = df.withColumn("__k", F.row_number().over(w)).withColumn("__m", F.count("*").over(Window.partitionBy()))
    step = step.withColumn("p_holm", F.least(F.lit(1.0), F.col(p) * (F.col("__m") - F.col("__k") + 1)))
    if monotone:
        step = step.withColumn("p_holm", F.max("p_holm").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)))
    return step.drop("__k", "__m")


def two_sided(z: float) -> float:
    """p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def with_p(df: DataFrame, z: str = "z") -> DataFrame:
    """Adds ``p``: two-sided, of a standard normal, to a table of tests; null where z is."""
    return df.withColumn("p", normal_p(F.col(z)))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal, by the continued series of its density (to about 1e-12 within 8 deviations)."""
    x = F.least(F.abs(z), F.lit(38.0))
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    # near the middle a power series, farther out a continued fraction
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")), lambda a, i: F.struct((a["term"] * x * x / (2 * i + 1)).alias("term"), (a["sum"] + a["term"] * x * x / (2 * i + 1)).alias("sum")))["sum"]
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda a, i: x + i / a)
    return F.when(z.isNotNull(), F.when(x < 3, 1 - 2 * density * series).otherwise(2 * density / fraction))


def wilcoxon_exact_p(n: int, w: float) -> float:
    """Two-sided p of a signed-rank sum ``w`` of n untied differences, from the counts of all sign choices."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    w = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
