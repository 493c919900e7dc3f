"""How many modes the normal rows have: the dip test by marginals and projections, Sarle's coefficient, mixtures.

Rows are (id, v). The panel is taken on a hash sample (``SAMPLE`` rows, its definition), so a
dimension or projection is one list of bounded length in a task; the lists are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ratio
from ..functions.ranks import hash_order, hash_unit
from ..functions.scratch import stored
from . import detectors as det

SAMPLE, PROJECTIONS, SIMULATIONS = 2000, 60, 400
#: Sarle's coefficient of a uniform distribution.
UNIFORM = 0.555


def _hull_gap(x: np.ndarray, below: np.ndarray, above: np.ndarray) -> float:
    """Greatest height of ``above`` over the greatest convex minorant of ``below``."""
    hull: list[int] = []
    for i in range(len(x)):
        while len(hull) > 1 and (below[hull[-1]] - below[hull[-2]]) * (x[i] - x[hull[-1]]) >= (below[i] - below[hull[-1]]) * (x[hull[-1]] - x[hull[-2]]):
            hull.pop()
        hull.append(i)
    return float((above - np.interp(x, x[hull], below[hull])).max())


def dip(values: np.ndarray) -> float:
    """Hartigan's dip: the least distance of the empirical distribution to a unimodal one.

    A unimodal distribution is convex ahead of its mode and concave after it. For a mode at a
    value, the convex part is at best half the greatest gap between the upper steps and the
    greatest convex minorant of the lower ones away, the concave part likewise with the least
    concave majorant; at the mode itself there may be a step. The first grows with the
    mode's place and the second falls, so their crossing is found by halving.
    """
    x, count = np.unique(np.asarray(values, float), return_counts=True)
    upto = np.cumsum(count) / count.sum()
    ahead = upto - count / count.sum()

    def left(m):
        above = upto[: m + 1].copy()
        above[m] = ahead[m]
        return _hull_gap(x[: m + 1], ahead[: m + 1], above)

    def right(m):  # the same, seen from the other end
        above = 1 - ahead[m:][::-1]
        above[-1] = 1 - upto[m]
        return _hull_gap(-x[m:][::-1], 1 - upto[m:][::-1], above)

    lo, hi = 0, len(x) - 1
    while lo < hi:  # the first mode whose left part is at least as far away as its right part
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if left(mid) >= right(mid) else (mid + 1, hi)
    best = min(max(left(m), right(m)) for m in {lo, max(lo - 1, 0)})
    return max(best / 2, 0.5 / count.sum())


def uniform_dips(spark, n: int, simulations: int = SIMULATIONS, seed: int = 0) -> DataFrame:
    """(dip) of samples of n uniform values: what a unimodal distribution gives at most, by chance."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"dip": [dip(np.random.default_rng([seed, int(i)]).random(n)) for i in batch["id"]]})

    return spark.range(simulations).repartition(16).mapInPandas(run, "dip double")


def dips(values: DataFrame, simulations: int = SIMULATIONS, seed: int = 0) -> DataFrame:
    """(what, dip, p) of lists of values (what, x), all of one length: p is the share of uniform samples with at least that dip."""
    n = values.groupBy("what").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    run = lambda pdf: pd.DataFrame({"what": [pdf["what"].iloc[0]], "dip": [dip(pdf["x"].to_numpy())]})
    found = stored(values.select("what", F.col("x").cast("double").alias("x")).groupBy("what").applyInPandas(run, "what string, dip double"), "dips")
    chance = stored(uniform_dips(values.sparkSession, int(n or 1), simulations, seed).withColumnRenamed("dip", "by_chance"), "uniform-dips")
    return found.join(F.broadcast(chance)).groupBy("what", "dip").agg(F.avg((F.col("by_chance") >= F.col("dip")).cast("double")).alias("p"))  # ``simulations`` rows


def sarle(points: DataFrame) -> DataFrame:
    """(dim, coefficient): (skew squared + 1) over the excess kurtosis with its small-sample term; constant dims are left out. ``points``: (dim, x)."""
    m = points.groupBy("dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"), F.count("*").cast("double").alias("n")).where("sd >= 1e-9")
    z = (F.col("x") - F.col("mu")) / F.col("sd")
    s = points.join(m, "dim").groupBy("dim", "n").agg(F.avg(z * z * z).alias("g"), F.avg(z * z * z * z).alias("k"))
    n = F.col("n")
    term = 3 * (n - 1) * (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0))
    return s.select("dim", ratio(F.col("g") * F.col("g") + 1, F.col("k") - 3 + term).alias("coefficient"))


def panel(rows: DataFrame, seed: int = 0, simulations: int = SIMULATIONS) -> DataFrame:
    """One row: dip_frac, mean_dip (by dimension), bc_frac (dims over the uniform's coefficient), dip_proj_frac, dip_proj_minp (random projections) and bestdir_p (the axis between two mixture parts)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    own = rows.orderBy(hash_order(F.lit(seed), "id")).limit(SAMPLE).select("id", F.lit(True).alias("train"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    z = stored(det.standardised(det.long_form(stored(own, "modality-sample"))), "standardised")
    live = stored(z.join(z.groupBy("dim").agg(F.stddev_pop("x").alias("sd")).where("sd >= 1e-9").select("dim"), "dim"), "live-dims")
    # directions by pairs of hashed uniforms, turned to normal numbers
    u = lambda part: hash_unit(F.lit(seed), F.lit(part), "r", "dim")
    w = live.select("dim").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(PROJECTIONS - 1))))
    w = w.withColumn("w", F.sqrt(-2 * F.log(1 - u("length"))) * F.cos(2 * np.pi * u("angle")))
    norm = w.groupBy("r").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, "r").select("dim", "r", (F.col("w") / (F.col("norm") + 1e-12)).alias("w"))
    projected = live.join(F.broadcast(w), "dim").groupBy("r", "id").agg(F.sum(F.col("x") * F.col("w")).alias("x"))  # dims * PROJECTIONS rows
    vectors = z.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v")).withColumn("train", F.lit(True))
    latent = stored(det.pca_embed(vectors, 8).select("id", array_to_vector("z").alias("features"), F.col("z").alias("v")), "latent")
    a, b = (np.array(r["mean"].toArray()) for r in GaussianMixture(k=2, seed=seed, maxIter=50).fit(latent).gaussiansDF.collect())  # two centres
    axis = (b - a) / (np.linalg.norm(b - a) + 1e-12)
    best = det.with_numpy(latent.select("id", "v"), lambda m: m @ axis).select(F.lit("best").alias("what"), F.col("score").alias("x"))
    lists = live.select(F.concat(F.lit("d"), F.col("dim").cast("string")).alias("what"), "x").union(projected.select(F.concat(F.lit("r"), F.col("r").cast("string")), "x")).union(best)
    found = dips(lists, simulations, seed)
    kind, multi = F.substring("what", 1, 1), (F.col("p") < 0.05).cast("double")
    of = lambda k, c: F.when(kind == k, c)
    one = found.agg(F.avg(of("d", multi)).alias("dip_frac"), F.avg(of("d", F.col("dip"))).alias("mean_dip"), F.avg(of("r", multi)).alias("dip_proj_frac"), F.min(of("r", F.col("p"))).alias("dip_proj_minp"), F.max(of("b", F.col("p"))).alias("bestdir_p"))
    return one.join(F.broadcast(sarle(z.select("dim", "x")).agg(F.avg((F.col("coefficient") > UNIFORM).cast("double")).alias("bc_frac"))))  # one row
