"""Where anomalies lie among the normal rows, and synthetic anomalies made in a latent space.

Rows are (id, train, v); the latent space is that of the standardised training rows, reduced to
16 principal components where they have more dims. Centres are a few dozen vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ratio
from ..functions.order import quantiles
from ..functions.ranks import hash_order, hash_unit
from ..functions.scratch import stored
from . import detectors as det

LATENT = 16


class Latent:
    """Standardisation and leading components of the training rows, with the way back."""

    def __init__(self, rows: DataFrame, most: int = LATENT, always: bool = False):
        _, self.mean, cov = det.moments(rows)
        self.sd = np.sqrt(np.diag(cov))
        self.sd[self.sd == 0] = 1
        cov = cov / np.outer(self.sd, self.sd)
        d = len(self.mean)
        self.vectors = det.components(cov, most=most)[1] if always or d > most else np.eye(d)
        self.cov = self.vectors.T @ cov @ self.vectors  # of the latent rows

    def to(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``v`` in the latent space."""
        mean, sd, vectors = self.mean, self.sd, self.vectors
        z = det.with_numpy(rows, lambda m: (((m - mean) / sd) @ vectors).tolist(), "id long, v array<double>")
        return z.join(rows.drop("v"), "id")

    def back(self, m: np.ndarray) -> np.ndarray:
        return (m @ self.vectors.T) * self.sd + self.mean


def percentiles(values: DataFrame) -> DataFrame:
    """(id, dim, pct): share of the training values strictly below, in per cent. ``values``: long (id, train, dim, x)."""
    return det.tails(values).select("id", "dim", (100 * (1 - F.col("ge"))).alias("pct"))


def anomaly_geometry(rows: DataFrame, neighbours: int = 10, share: float = 0.95) -> DataFrame:
    """(id, radial_pct, density_pct, recon_pct, between, place) of the rows that aren't training rows.

    radial: distance to the nearest centre; density: to a near training row; recon: what the
    components of ``share`` of the variance leave. place: outside (radial over the 99th
    percentile of training rows), between (over the 90th and about as near to the second centre),
    edge (over the 90th), inside.
    """
    latent = Latent(rows)
    z = stored(latent.to(rows.select("id", "train", "v")), "latent")
    n = z.where("train").count()
    _, centres = det.clusters(z, min(20, max(2, n // 30)))
    vectors = det.components(latent.cov, share)[1]
    mean = det.moments(z)[1]

    def measure(m):
        near = np.sort(np.sqrt(((m[:, None, :] - centres[None]) ** 2).sum(2)), axis=1)
        rest = (m - mean) - (m - mean) @ vectors @ vectors.T
        return np.column_stack([near[:, 0], near[:, 0] / (near[:, 1] + 1e-9), np.sqrt((rest**2).sum(1))]).tolist()

    own = det.with_numpy(z, measure, "id long, m array<double>")
    far = det.nearest(z, min(neighbours, n - 1)).where(F.col("rank") == min(neighbours, n - 1)).select("id", "distance")
    own = own.join(far, "id").join(z.select("id", "train"), "id").select("id", "train", F.get("m", F.lit(0)).alias("radial"), F.get("m", F.lit(1)).alias("between"), "distance", F.get("m", F.lit(2)).alias("recon"))
    own = stored(own, "geometry")
    values = own.select("id", "train", F.posexplode(F.array("radial", "distance", "recon")).alias("dim", "x"))
    pct = percentiles(values).groupBy("id").agg(*(F.max(F.when(F.col("dim") == i, F.col("pct"))).alias(f"{name}_pct") for i, name in enumerate(("radial", "density", "recon"))))
    out = own.where("not train").select("id", "between").join(pct, "id")
    return out.select("id", "radial_pct", "density_pct", "recon_pct", "between", place(F.col("radial_pct"), F.col("between")).alias("place"))


def place(radial, between):
    return F.when(radial > 99, "outside").when((radial >= 90) & (between > 0.8), "between").when(radial >= 90, "edge").otherwise("inside")


def _near_band(points: DataFrame, z: DataFrame, n: int, k: int, band: tuple[float, float]) -> DataFrame:
    """The first n points, by id, whose distance to the k-th of the rows ``z`` lies within that band of the rows' own."""
    own = det.nearest(z, k).where(F.col("rank") == k)
    cut = quantiles(own, [], "distance", [b / 100 for b in band])
    far = det.nearest(points, k, z).where(F.col("rank") == k).join(F.broadcast(cut))  # one row
    good = far.where((F.col("distance") >= F.get("q", F.lit(0))) & (F.col("distance") <= F.get("q", F.lit(1)))).select("id")
    return points.join(good, "id").orderBy("id").limit(n)


def between_centres(rows: DataFrame, n: int = 100, band: tuple[float, float] = (60, 95), seed: int = 0) -> DataFrame:
    """(id, v): synthetic anomalies between two centres of the training rows, at a density of their outer parts. None if fewer than 10."""
    latent = Latent(rows, always=True)
    z = stored(latent.to(rows.where("train").select("id", "train", "v")), "latent")
    size = z.count()
    _, centres = det.clusters(z, min(20, max(3, size // 40)), seed)
    spread = np.sqrt(np.diag(latent.cov))

    def run(batches):
        for batch in batches:
            out = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                a, b = rng.choice(len(centres), 2, replace=False)
                t = rng.uniform(0.35, 0.65)
                out.append((t * centres[a] + (1 - t) * centres[b] + rng.normal(0, 0.15 * spread)).tolist())
            yield pd.DataFrame({"id": -1 - batch["id"], "v": out})  # ids of their own, so that no row is left out as a neighbour

    points = stored(rows.sparkSession.range(n * 12).mapInPandas(run, "id long, v array<double>"), "candidates")
    kept = _near_band(points, z.select("id", "train", "v"), n, min(10, size - 1), band).select((-1 - F.col("id")).alias("id"), "v")
    kept = kept.withColumn("__n", F.count("*").over(Window.partitionBy())).where("__n >= 10").drop("__n")  # n rows at most
    return det.with_numpy(kept, lambda m: latent.back(m).tolist(), "id long, v array<double>")


def displaced(rows: DataFrame, seed: int = 1) -> DataFrame:
    """(id, v): of each training row one moved towards another cluster's centre, from half the way to beyond it."""
    latent = Latent(rows, always=True)
    z = latent.to(rows.where("train").select("id", "train", "v"))
    n = rows.where("train").count()
    label, centres = det.clusters(z, min(20, max(3, n // 40)), 0)
    k = len(centres)
    other = F.floor(hash_unit(F.lit(seed), F.lit("centre"), "id") * k).cast("int")
    own = z.join(label, "id").withColumn("other", F.when(other == F.col("cluster"), (other + 1) % k).otherwise(other)).withColumn("t", 0.5 + 0.8 * hash_unit(F.lit(seed), F.lit("t"), "id"))

    def run(batches):
        for batch in batches:
            m = np.array(batch["v"].tolist(), float).reshape(len(batch), -1)
            moved = m + batch["t"].to_numpy()[:, None] * (centres[batch["other"].to_numpy()] - m) if len(m) else m
            yield pd.DataFrame({"id": batch["id"], "v": latent.back(moved).tolist() if len(m) else []})

    return own.select("id", "v", "other", "t").mapInPandas(run, "id long, v array<double>")


def off_clusters(rows: DataFrame, synthetic: DataFrame, band: float = 60, least: int = 10) -> DataFrame:
    """The synthetic rows (id, v) farther from every centre than that percentile of the training rows; all of them if fewer than ``least`` are."""
    latent = Latent(rows)
    z = stored(latent.to(rows.where("train").select("id", "train", "v")), "latent")
    _, centres = det.clusters(z, min(20, max(2, z.count() // 30)))
    far = lambda t: det.with_numpy(t, lambda m: np.sqrt(((m[:, None, :] - centres[None]) ** 2).sum(2)).min(1))
    cut = quantiles(far(z), [], "score", [band / 100]).select(F.get("q", F.lit(0)).alias("cut"))
    own = synthetic.join(far(latent.to(synthetic)).join(F.broadcast(cut)).select("id", (F.col("score") > F.col("cut")).alias("far")), "id")  # one row
    own = stored(own, "off-clusters")
    enough = own.agg((F.count_if("far") >= least).alias("enough"))
    return own.join(F.broadcast(enough)).where(F.col("far") | ~F.col("enough")).select("id", "v")  # one row


def reconstruction_error(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """(id, score): what the leading components of the standardised training rows leave of a row (stands in for an auto-encoder's error)."""
    latent = Latent(rows, most=1 << 30)
    vectors = det.components(latent.cov, share)[1]
    mean, sd = latent.mean, latent.sd
    return det.with_numpy(rows, lambda m: np.sqrt(((((m - mean) / sd) - ((m - mean) / sd) @ vectors @ vectors.T) ** 2).sum(1)))


def silhouette(points: DataFrame, most: int = 1000, seed: int = 0) -> DataFrame:
    """(silhouette): mean over a hash sample of at most ``most`` rows of (b - a) / max(a, b), distances Euclidean. Null for one cluster.

    ``points``: (id, cluster, v). The sample is the feature: distances are taken between its rows only.
    """
    s = stored(points.orderBy(hash_order(F.lit(seed), "id")).limit(most).select("id", "cluster", "v"), "silhouette")
    sizes = s.groupBy("cluster").agg(F.count("*").alias("size"))
    pairs = det.nearest(s.select("id", "v"), most, s.select("id", "v"))  # all pairs of the sample
    mean = pairs.join(s.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id", "cluster").agg(F.sum("distance").alias("d"))
    mean = mean.join(sizes, "cluster").join(s.select("id", F.col("cluster").alias("own")), "id")
    same = F.col("cluster") == F.col("own")
    per = mean.groupBy("id").agg(F.max(F.when(same, F.col("d") / (F.col("size") - 1))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("size"))).alias("b"))
    # a row alone in its cluster has no mean distance there and counts 0
    score = F.when(F.col("b").isNotNull(), F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)))
    return per.agg(F.avg(score).alias("silhouette"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """(ari): agreement of two labellings (a, b) of the same rows, from the contingency table's pair counts."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    table = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = table.agg(two("n").alias("both"), F.sum("n").alias("rows"))
    margin = lambda c: table.groupBy(c).agg(F.sum("n").alias("n")).agg(two("n").alias(f"of_{c}"))
    one = both.join(F.broadcast(margin("a"))).join(F.broadcast(margin("b")))  # one row each
    expected = ratio(F.col("of_a") * F.col("of_b"), F.col("rows") * (F.col("rows") - 1) / 2.0)
    most = (F.col("of_a") + F.col("of_b")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def mixture_modes(rows: DataFrame, most: int = 15, seed: int = 0) -> DataFrame:
    """(k, bic): Bayesian information criterion of Gaussian mixtures of 1 to ``most`` parts over (id, v)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    data = stored(rows.select(array_to_vector("v").alias("features")), "mixture")
    n, mean, cov = det.moments(rows.withColumn("train", F.lit(True)))
    d, found = len(mean), []
    for k in range(1, most + 1):
        if k == 1:  # one part has the rows' own mean and covariance
            log_likelihood = -n / 2 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov + 1e-12 * np.eye(d))[1] + d)
        else:
            log_likelihood = GaussianMixture(k=k, seed=seed, maxIter=50).fit(data).summary.logLikelihood
        found.append((k, float((k - 1 + k * d + k * d * (d + 1) / 2) * np.log(n) - 2 * log_likelihood)))
    return rows.sparkSession.createDataFrame(found, "k int, bic double")
