"""Deterministic synthetic data: every number is hashed from its row, so partitions don't matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import hash_unit

NORMAL, ODD = 1500, 60


def gauss(*parts) -> Column:
    """Standard normal by Box and Muller from two hashed numbers."""
    u, v = hash_unit(*parts, F.lit("u")), hash_unit(*parts, F.lit("v"))
    return F.sqrt(-2 * F.log(u + 2.0**-33)) * F.cos(2 * math.pi * v)


def tabular(spark: SparkSession, kind: str, seed: int = 0) -> DataFrame:
    """(dataset, row_id, features, label): blobs, moons, ring, wide or dense_off_centre."""
    d = {"blobs": 8, "moons": 6, "ring": 5, "wide": 20, "dense_off_centre": 5}[kind]
    rows = spark.range(NORMAL + ODD).select(F.col("id").alias("row_id"), (F.col("id") >= NORMAL).cast("int").alias("label"))
    g = [gauss(F.lit(seed), F.lit(kind), "row_id", F.lit(j)) for j in range(d)]
    u = [hash_unit(F.lit(seed), F.lit(kind + "u"), "row_id", F.lit(j)) for j in range(d)]
    odd = F.col("label") == 1
    if kind == "blobs":
        centre = F.floor(u[0] * 3) * 6 - 6
        x = [F.when(odd, (u[j] - 0.5) * 24).otherwise(centre * (1 if j % 2 else -1) + g[j]) for j in range(d)]
    elif kind == "moons":
        t, upper = u[0] * math.pi, u[1] < 0.5
        flat = [F.when(upper, F.cos(t)).otherwise(1 - F.cos(t)) + 0.1 * g[0], F.when(upper, F.sin(t)).otherwise(0.5 - F.sin(t)) + 0.1 * g[1]]
        x = [F.when(odd, (u[j + 2] - 0.5) * 5).otherwise(flat[j]) for j in range(2)] + [0.3 * g[j] for j in range(2, d)]
    elif kind == "ring":
        t = 2 * math.pi * u[0]
        x = [F.when(odd, 0.5 * g[0]).otherwise(4 * F.cos(t) + 0.3 * g[0]), F.when(odd, 0.5 * g[1]).otherwise(4 * F.sin(t) + 0.3 * g[1])] + [0.3 * g[j] for j in range(2, d)]
    elif kind == "wide":
        x = [F.when(odd, 3.0 * g[j]).otherwise(g[j]) for j in range(d)]
    else:
        x = [F.when(odd, 2.5 + 0.1 * g[j]).otherwise(g[j]) for j in range(d)]
    return rows.select(F.lit(kind).alias("dataset"), "row_id", F.array(*x).alias("features"), "label")


LENGTH = 10_000
INJECTIONS = ("none", "spike", "subsequence", "trend", "amplitude", "frequency", "mixed")


def series(spark: SparkSession, kind: str, seed: int = 0, period: int = 100) -> DataFrame:
    """(series, pos, value, label): a seasonal base with noise and, in ten hash-placed stretches, one kind of change."""
    rows = spark.range(LENGTH).select(F.col("id").alias("pos"))
    slot = F.floor(F.col("pos") / 1000)
    start = slot * 1000 + F.floor(hash_unit(F.lit(seed), F.lit(kind), slot) * 850)
    width = 1 if kind == "spike" else 120
    inside = (F.col("pos") >= start) & (F.col("pos") < start + width) & F.lit(kind != "none")
    phase = 2 * math.pi * F.col("pos") / period
    base = F.sin(phase) + 0.1 * gauss(F.lit(seed), F.lit("noise"), "pos")
    changed = {
        "none": base, "spike": base + 6, "subsequence": F.sign(F.sin(phase)) + 0 * base, "trend": base + (F.col("pos") - start) / 40.0, "amplitude": 3 * base, "frequency": F.sin(3 * phase),
    }
    pick = F.pmod(slot, F.lit(3))
    mixed = F.when(pick == 0, changed["trend"]).when(pick == 1, changed["amplitude"]).otherwise(changed["frequency"])
    value = F.when(inside, mixed if kind == "mixed" else changed[kind]).otherwise(base)
    return rows.select(F.lit(kind).alias("series"), "pos", value.alias("value"), inside.cast("int").alias("label"))
