"""Anomaly detectors: fitted on the rows with ``train``, scoring all; higher is more anomalous.

Input is long, one row per (id, dim) with value ``x`` and boolean ``train``; output (id, score).
Statistics per dimension are small tables (dims, or dims times bins) and join by broadcast
where AQE finds them small. Models that need matrices take the vector form and use numpy on
aggregated moments or on bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ratio
from ..functions.order import quantiles
from ..functions.scratch import stored
from . import near


def long_form(df: DataFrame, vector: str = "v", dims: int | None = None) -> DataFrame:
    """(id, train, dim, x) of a table with array<double> ``v``."""
    at = F.posexplode(F.slice(vector, 1, dims) if dims else F.col(vector)).alias("dim", "x")
    return df.select("id", "train", at).withColumn("x", F.col("x").cast("double"))


def standardised(df: DataFrame) -> DataFrame:
    """x centred and scaled by the population deviation of the training rows; a deviation of 0 counts as 1."""
    s = df.where("train").groupBy("dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    return df.join(s, "dim").select("id", "train", "dim", ((F.col("x") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("x"))


def max_z(df: DataFrame) -> DataFrame:
    s = df.where("train").groupBy("dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = F.abs((F.col("x") - F.col("mu")) / (F.col("sd") + 1e-9))
    return df.join(s, "dim").groupBy("id").agg(F.max(z).alias("score"))


def centroid_distance(df: DataFrame) -> DataFrame:
    s = df.where("train").groupBy("dim").agg(F.avg("x").alias("mu"))
    return df.join(s, "dim").groupBy("id").agg(F.sqrt(F.sum((F.col("x") - F.col("mu")) * (F.col("x") - F.col("mu")))).alias("score"))


def histograms(df: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """(df with ``bin``, table of (dim, bin, density, share)): equal widths over the training range, values outside clamped, constant dims left out."""
    edges = df.where("train").groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("m")).where("hi > lo")
    place = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    binned = df.join(edges, "dim").withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int"))
    dens = binned.where("train").groupBy("dim", "bin", "lo", "hi", "m").agg((F.count("*") / F.col("m")).alias("share"))
    return binned, dens.select("dim", "bin", (F.col("share") / ((F.col("hi") - F.col("lo")) / bins)).alias("density"), "share")


def hbos(df: DataFrame, bins: int = 20) -> DataFrame:
    binned, dens = histograms(df, bins)
    return binned.join(dens, ["dim", "bin"], "left").groupBy("id").agg(F.sum(-F.log2(F.coalesce("density", F.lit(0.0)) + 1e-9)).alias("score"))


#: Ranges of values into which a dimension is dealt when places among its values are counted.
RANGES = 64


def tails(df: DataFrame) -> DataFrame:
    """Adds l and r: share of training values at most and at least x, floored at half a row, le and ge (the same, not floored), m (training rows) and the sign of the skew.

    The training values of a dimension are reduced to counts per distinct value. Distinct values
    are dealt into ranges by approximate quantiles; a value's place is the count of the ranges
    before it and a window within its range, so no task holds all values of a dimension.
    """
    bounds = F.percentile_approx("x", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 1000)
    stats = df.where("train").groupBy("dim").agg(F.avg("x").alias("mu"), F.count("*").alias("m"), bounds.alias("bounds"))
    cube = (F.col("x") - F.col("mu")) * (F.col("x") - F.col("mu")) * (F.col("x") - F.col("mu"))
    skew = df.where("train").join(stats, "dim").groupBy("dim", "m").agg(F.signum(F.sum(cube)).alias("skew"))
    marks = df.groupBy("dim", "x").agg(F.count_if("train").alias("c")).join(stats.select("dim", "bounds"), "dim")
    marks = marks.select("dim", "x", "c", F.size(F.filter("bounds", lambda b: b < F.col("x"))).alias("range"))
    before = marks.groupBy("dim", "range").agg(F.sum("c").alias("n"))
    upto = Window.partitionBy("dim").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    before = before.select("dim", "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("dim", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("le", F.sum("c").over(within)).join(before, ["dim", "range"]).withColumn("le", F.col("le") + F.col("before")).join(skew, "dim")
    floor = lambda c: F.greatest(c / F.col("m"), F.lit(0.5) / F.col("m"))
    ge = F.col("m") - F.col("le") + F.col("c")
    return df.join(marks.select("dim", "x", floor(F.col("le")).alias("l"), floor(ge).alias("r"), (F.col("le") / F.col("m")).alias("le"), (ge / F.col("m")).alias("ge"), "m", "skew"), ["dim", "x"])


def ecod(df: DataFrame) -> DataFrame:
    t = tails(df)
    auto = F.when(F.col("skew") < 0, -F.log("l")).otherwise(-F.log("r"))
    return t.groupBy("id").agg(F.greatest(F.sum(-F.log("l")), F.sum(-F.log("r")), F.sum(auto)).alias("score"))


def copod(df: DataFrame) -> DataFrame:
    t = tails(df)
    l, r = -F.log("l"), -F.log("r")
    skewed = F.when(F.col("skew") < 0, l).when(F.col("skew") > 0, r).otherwise(l + r)
    return t.groupBy("id").agg(F.sum(F.greatest(skewed, (l + r) / 2)).alias("score"))


def surprises(df: DataFrame, bins: int = 30) -> DataFrame:
    """(id, dim, tail, own, outside): two-sided tail surprise (floor at half a row), surprise of the bin's share of rows, and whether x lies
    outside the training range or in a bin without training rows. Dims that are constant in training are left out."""
    t = tails(df).withColumnRenamed("m", "__m")
    binned, dens = histograms(t, bins)
    tail = -F.log(F.greatest(2 * F.least(F.col("le"), 1 - F.col("le")), F.lit(0.5) / F.col("__m")))
    share = F.coalesce("share", F.lit(0.0))
    outside = (F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi")) | (share == 0)
    return binned.join(dens, ["dim", "bin"], "left").select("id", "dim", tail.alias("tail"), (-F.log(share + 1e-9)).alias("own"), outside.alias("outside"))


def _largest(df: DataFrame, parts: DataFrame, value: Column) -> DataFrame:
    """(id, score): the largest value of a row's dims, 0 for rows without any."""
    found = parts.groupBy("id").agg(F.greatest(F.max(value), F.lit(0.0)).alias("score"))
    return df.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def severity(df: DataFrame, bins: int = 30) -> DataFrame:
    """Largest over the dimensions of the two-sided tail surprise and the surprise of the bin."""
    return _largest(df, surprises(df, bins), F.greatest("tail", "own"))


def edge_severity(df: DataFrame, bins: int = 30) -> DataFrame:
    """The half of ``severity`` that looks at tails only."""
    return _largest(df, surprises(df, bins), F.col("tail"))


def histogram_severity(df: DataFrame, bins: int = 30) -> DataFrame:
    """The half of ``severity`` that looks at bins only, gaps inside the range among them."""
    return _largest(df, surprises(df, bins), F.col("own"))


def support_rule(df: DataFrame, bins: int = 30, rare: float = 20.0) -> DataFrame:
    """(id, n_outside, score): dims out of the training support, and the largest surprise, ``rare`` where out of support."""
    s = surprises(df, bins).groupBy("id").agg(F.count_if("outside").alias("n_outside"), F.max(F.when(F.col("outside"), rare).otherwise(F.col("own"))).alias("score"))
    return df.select("id").distinct().join(s, "id", "left").select("id", F.coalesce("n_outside", F.lit(0).cast("long")).alias("n_outside"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))


def outside_rules(df: DataFrame) -> DataFrame:
    """(id, beyond_range, beyond_quantiles, beyond_bonferroni): any dimension outside the training range, its 1st to 99th percentile, or the 1 % level shared by all dims."""
    d = df.select("dim").distinct().count()
    at = [0.01, 0.99, 0.005 / d, 1 - 0.005 / d]
    train = df.where("train")
    s = train.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(quantiles(train, ["dim"], "x", at), "dim")
    x, q = F.col("x"), F.col("q")
    out = lambda a, b: F.max(((x < a) | (x > b)).cast("int"))
    return df.join(s, "dim").groupBy("id").agg(
        out(F.col("lo"), F.col("hi")).alias("beyond_range"), out(F.get(q, F.lit(0)), F.get(q, F.lit(1))).alias("beyond_quantiles"), out(F.get(q, F.lit(2)), F.get(q, F.lit(3))).alias("beyond_bonferroni")
    )


#: Rows of a block of queries whose neighbours are searched together.
NEAR_BLOCK = near.BLOCK


def nearest(df: DataFrame, k: int, train: DataFrame | None = None) -> DataFrame:
    """(id, other, distance, rank) of the k nearest training rows, the row itself left out, ties by id.

    ``df`` has id and vector ``v``; see ``near`` for the index that spares most distances.
    """
    train = df.where("train") if train is None else train
    own = lambda t: t.select(F.lit(0).alias("task"), F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    return near.nearest(own(df), own(train), k, size=NEAR_BLOCK).drop("task")


def knn(df: DataFrame, k: int = 5) -> DataFrame:
    """Distance to the k-th nearest training row."""
    return nearest(df, k).where(F.col("rank") == k).select("id", F.col("distance").alias("score"))


def knn_mean(df: DataFrame, k: int = 10) -> DataFrame:
    return nearest(df, k).groupBy("id").agg(F.avg("distance").alias("score"))


def lof(df: DataFrame, k: int = 10) -> DataFrame:
    """Local outlier factor: mean density of the neighbours over the row's own."""
    found = stored(nearest(df, k), "lof-neighbours")  # read three times
    reach = found.where(F.col("rank") == k).select(F.col("id").alias("other"), F.col("distance").alias("kd"))
    dens = found.join(reach, "other").groupBy("id").agg((1 / (F.avg(F.greatest("distance", "kd")) + 1e-10)).alias("lrd"))
    other = dens.select(F.col("id").alias("other"), F.col("lrd").alias("lrd_other"))
    return found.join(other, "other").join(dens, "id").groupBy("id").agg(F.avg(F.col("lrd_other") / F.col("lrd")).alias("score"))


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and population covariance of the training rows' ``v``: sums of d and d * d numbers, whatever the rows."""
    def run(batches):
        n, s, ss = 0, None, None
        for batch in batches:
            m = np.array(batch["v"].tolist(), float).reshape(len(batch), -1)
            if len(m):
                n, s, ss = n + len(m), m.sum(0) + (0 if s is None else s), m.T @ m + (0 if ss is None else ss)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = df.where("train").select("v").mapInPandas(run, "n long, s array<double>, ss array<double>")
    sums = parts.select("n", F.posexplode(F.concat("s", "ss")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    n = sums[0]["n"]
    flat = np.array([r["x"] for r in sums])
    d = int((-1 + np.sqrt(1 + 4 * len(flat))) / 2)
    mean = flat[:d] / n
    return n, mean, flat[d:].reshape(d, d) / n - np.outer(mean, mean)


def components(cov: np.ndarray, share: float | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors, largest first; each vector's largest loading is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    keep = len(values) if most is None else min(most, len(values))
    if share is not None:
        keep = min(keep, int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12)) + 1)
    return values[:keep], vectors[:, :keep]


def with_numpy(df: DataFrame, f, schema: str = "id long, score double") -> DataFrame:
    """(id, f(matrix of v)) batch by batch."""
    name, kind = schema.split(", ")[1].split(" ", 1)

    def run(batches):
        for batch in batches:
            m = np.array(batch["v"].tolist(), float).reshape(len(batch), -1)
            out = f(m) if len(m) else np.zeros(0)
            yield pd.DataFrame({"id": batch["id"], name: list(out) if kind != "double" else out})

    return df.select("id", "v").mapInPandas(run, schema)


def pca_embed(df: DataFrame, most: int = 16, share: float | None = None, whiten: bool = False) -> DataFrame:
    """(id, z): projections of the standardised rows on the leading components."""
    _, mean, cov = moments(df)
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1
    values, vectors = components(cov / np.outer(sd, sd), share, most)
    scale = np.where(values > 1e-12, np.sqrt(values), 1) if whiten else np.ones(len(values))
    return with_numpy(df, lambda m: (((m - mean) / sd) @ vectors / scale).tolist(), "id long, z array<double>")


def pca_score(df: DataFrame, share: float | None = None) -> DataFrame:
    """Squared projections weighted by the inverse eigenvalues."""
    _, mean, cov = moments(df)
    values, vectors = components(cov, share)
    good = values > 1e-9 * max(values[0], 1e-300)
    return with_numpy(df, lambda m: (((m - mean) @ vectors[:, good]) ** 2 / values[good]).sum(1))


def linear_residual(df: DataFrame, alpha: float = 1.0, most: int = 120) -> DataFrame:
    """Largest standardised residual of a dimension against a ridge regression on the others."""
    n, mean, cov = moments(df)
    d = len(mean)
    if d < 2 or d > most:
        return df.select("id", F.lit(None).cast("double").alias("score"))
    coef, sd = np.zeros((d, d)), np.zeros(d)
    for j in range(d):
        rest = np.arange(d) != j
        w = np.linalg.solve(n * cov[np.ix_(rest, rest)] + alpha * np.eye(d - 1), n * cov[rest, j])
        coef[rest, j] = w
        sd[j] = np.sqrt(max(cov[j, j] - 2 * w @ cov[rest, j] + w @ cov[np.ix_(rest, rest)] @ w, 0))
    return with_numpy(df, lambda m: (np.abs((m - mean) - (m - mean) @ coef) / (sd + 1e-9)).max(1))


def isolation_forest(df: DataFrame, trees: int = 100, rows: int = 256, seed: int = 0, features: float = 1.0) -> DataFrame:
    """Mean path length over trees grown on a hash-chosen sample of ``trees * rows`` training rows at most, each on that share of the dims."""
    from ..functions.ranks import hash_order

    take = df.where("train").orderBy(hash_order(F.lit(seed), F.col("id"))).limit(min(trees * rows, 25_600)).select("v").toPandas()
    data, rng = np.array(take["v"].tolist(), float), np.random.default_rng(seed)
    size = min(rows, len(data))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def average(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(m, depth, dims):
        span = dims[m[:, dims].max(0) > m[:, dims].min(0)] if len(m) > 1 else []
        if depth >= limit or len(span) == 0:
            return depth + average(len(m))
        j = int(rng.choice(span))
        cut = rng.uniform(m[:, j].min(), m[:, j].max())
        below = m[:, j] < cut
        return j, cut, grow(m[below], depth + 1, dims), grow(m[~below], depth + 1, dims)

    dims = data.shape[1]
    some = lambda: np.arange(dims) if features >= 1 else rng.choice(dims, max(1, int(features * dims)), replace=False)
    forest = [grow(data[rng.choice(len(data), size, replace=False)], 0, some()) for _ in range(trees)]

    def walk(m, tree, index, out):
        if not isinstance(tree, tuple):
            out[index] += tree
            return
        j, cut, a, b = tree
        below = m[index, j] < cut
        for part, side in ((index[below], a), (index[~below], b)):
            if len(part):
                walk(m, side, part, out)

    def score(m):
        out = np.zeros(len(m))
        for tree in forest:
            walk(m, tree, np.arange(len(m)), out)
        return 2 ** (-out / len(forest) / max(average(size), 1e-12))

    return with_numpy(df, score)


def loda(df: DataFrame, cuts: int = 50, bins: int = 20, seed: int = 0) -> DataFrame:
    """Mean surprise over histograms of sparse random projections."""
    _, mean, _ = moments(df)
    d, rng = len(mean), np.random.default_rng(seed)
    w = np.zeros((d, cuts))
    for j in range(cuts):
        pick = rng.choice(d, max(1, int(np.sqrt(d))), replace=False)
        w[pick, j] = rng.standard_normal(len(pick))
    projected = with_numpy(df, lambda m: ((m - mean) @ w).tolist(), "id long, v array<double>").join(df.select("id", "train"), "id")
    return hbos(long_form(projected), bins).select("id", (F.col("score") / cuts).alias("score"))


def clusters(df: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster) by k-means of the training rows, and the centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select("id", "train", array_to_vector("v").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=30).fit(rows.where("train"))
    return model.transform(rows).select("id", F.col("prediction").alias("cluster")), np.array(model.clusterCenters())


def cblof(df: DataFrame, k: int = 8, alpha: float = 0.9, beta: float = 5.0, seed: int = 0) -> DataFrame:
    """Distance to the row's own centre if its cluster is large, else to the nearest large one."""
    label, centres = clusters(df, k, seed)
    sizes = {r["cluster"]: r["count"] for r in label.groupBy("cluster").count().collect()}  # k rows
    order, total, large, run = sorted(sizes, key=lambda c: -sizes[c]), sum(sizes.values()), [], 0
    for i, c in enumerate(order):
        large.append(c)
        run += sizes[c]
        after = sizes[order[i + 1]] if i + 1 < len(order) else 0
        if run >= alpha * total or (after and sizes[c] / after >= beta):
            break
    big = centres[large]
    return with_numpy(df, lambda m: np.sqrt(((m[:, None, :] - big[None]) ** 2).sum(2)).min(1))


def cluster_composite(points: DataFrame, top: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cluster, size, size_component, far_component, density_component, composite).

    ``points``: long (id, cluster, dim, x) and the key columns ``by``, each value a clustering of its own.
    Smallness, distance to the nearest other centres and looseness, each min-max scaled and averaged.
    """
    by = list(by)
    centre = points.groupBy(*by, "cluster", "dim").agg(F.avg("x").alias("c"))
    a, b = centre.select(*by, F.col("cluster").alias("a"), "dim", F.col("c").alias("ca")), centre.select(*by, F.col("cluster").alias("b"), "dim", F.col("c").alias("cb"))
    gap = a.join(b, [*by, "dim"]).where("a <> b").groupBy(*by, "a", "b").agg(F.sqrt(F.sum((F.col("ca") - F.col("cb")) * (F.col("ca") - F.col("cb")))).alias("g"))
    near = gap.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "a").orderBy("g", "b"))).where(F.col("__k") <= top)
    far = near.groupBy(*by, F.col("a").alias("cluster")).agg(F.avg("g").alias("far"))
    spread = points.join(centre, [*by, "cluster", "dim"]).groupBy(*by, "cluster", "id").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("d"))
    per = spread.groupBy(*by, "cluster").agg(F.count("*").alias("size"), F.avg("d").alias("density")).join(far, [*by, "cluster"], "left").na.fill(0.0, ["far"])
    whole = Window.partitionBy(*by)  # a row per cluster
    scale = lambda c: F.when(F.max(c).over(whole) > F.min(c).over(whole), (c - F.min(c).over(whole)) / (F.max(c).over(whole) - F.min(c).over(whole))).otherwise(0.0)
    per = per.withColumn("small", 1 - F.col("size") / F.sum("size").over(whole))
    per = per.select(*by, "cluster", "size", scale(F.col("small")).alias("size_component"), scale(F.col("far")).alias("far_component"), scale(F.col("density")).alias("density_component"))
    return per.withColumn("composite", (F.col("size_component") + F.col("far_component") + F.col("density_component")) / 3)


def guarded(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Null for all scores of a group that has a non-finite one or no spread."""
    s = F.col("score")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    keys = [f"{g}_" for g in groups]
    sound = scores.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True))).agg(((F.max(bad.cast("int")) == 0) & (F.stddev_pop(F.when(~bad, s)) >= 1e-12)).alias("__sound"))
    same = F.lit(True)
    for g, k in zip(groups, keys, strict=True):
        same = same & scores[g].eqNullSafe(sound[k])
    return scores.join(sound, same).withColumn("score", F.when(F.col("__sound"), s)).drop("__sound", *keys)


def mass_and_volume(scores: DataFrame, uniform: DataFrame, steps: int = 100) -> DataFrame:
    """(detector, i, t, mass, volume): shares of the rows and of the uniform points that score at most the i-th of ``steps`` thresholds
    over the pooled range. Both inputs are (detector, score), anomaly scores: low ones are the normal region."""
    both = scores.select("detector", "score").union(uniform.select("detector", "score"))
    box = both.groupBy("detector").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    t = box.select("detector", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (steps - 1)).alias("t"))

    def at_most(df, name):
        step = F.when(F.col("hi") > F.col("lo"), F.ceil(F.round((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (steps - 1), 9))).otherwise(0)
        per = df.join(box, "detector").groupBy("detector", step.cast("int").alias("i")).agg(F.count("*").alias("c"))
        per = t.join(per, ["detector", "i"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
        w = Window.partitionBy("detector")  # ``steps`` rows
        return per.select("detector", "i", "t", (F.sum("c").over(w.orderBy("i")) / F.sum("c").over(w)).alias(name))

    return at_most(scores, "mass").join(at_most(uniform, "volume").drop("t"), ["detector", "i"])


def em_curve(scores: DataFrame, uniform: DataFrame, steps: int = 100) -> DataFrame:
    """(detector, lam, em): greatest of mass - lam * volume over thresholds, lam from 0 to 1 in ``steps``."""
    curve = mass_and_volume(scores, uniform, steps)
    lam = curve.sparkSession.range(0, steps).select((F.col("id") / (steps - 1)).alias("lam"))
    return curve.join(F.broadcast(lam)).groupBy("detector", "lam").agg(F.max(F.col("mass") - F.col("lam") * F.col("volume")).alias("em"))  # ``steps`` rows


def em_mv(scores: DataFrame, uniform: DataFrame, steps: int = 100, alphas: int = 50) -> DataFrame:
    """(detector, em, mv): area under the excess-mass curve (high is good), and under volume by mass from 0.9 to 0.999 (low is good)."""
    area = lambda x, y: F.sum((F.col(f"{x}1") - F.col(x)) * (F.col(y) + F.col(f"{y}1")) / 2)
    ahead = lambda df, x, *cols: df.select("*", *(F.lead(c).over(Window.partitionBy("detector").orderBy(x)).alias(f"{c}1") for c in cols))
    em = ahead(em_curve(scores, uniform, steps), "lam", "lam", "em").groupBy("detector").agg(area("lam", "em").alias("em"))
    curve = mass_and_volume(scores, uniform, steps).groupBy("detector").agg(F.array_sort(F.collect_list(F.struct("mass", "i", "volume"))).alias("z"))  # ``steps`` rows
    curve = curve.select("detector", "z", F.explode(F.sequence(F.lit(0), F.lit(alphas - 1))).alias("j"))
    alpha = F.lit(0.9) + F.col("j") * (0.999 - 0.9) / (alphas - 1)
    curve = curve.select("detector", "j", alpha.alias("a"), "z", F.size(F.filter("z", lambda p: p["mass"] <= alpha)).alias("k"))
    lo, hi = F.get("z", F.greatest(F.col("k") - 1, F.lit(0))), F.get("z", F.least(F.col("k"), F.size("z") - 1))
    slope = F.when((F.col("k") == 0) | (hi["mass"] == lo["mass"]), 0.0).otherwise((hi["volume"] - lo["volume"]) / (hi["mass"] - lo["mass"]) * (F.col("a") - lo["mass"]))
    mv = ahead(curve.select("detector", "a", (lo["volume"] + slope).alias("v")), "a", "a", "v").groupBy("detector").agg(area("a", "v").alias("mv"))
    return em.join(mv, "detector")


def goix(scores: DataFrame, uniform: DataFrame, t_most: float = 100.0, em_until: float = 0.9, steps: int = 1000) -> DataFrame:
    """(detector, em, mv): the other variant. Regions are the rows above each score met, in normality.

    em integrates max over scores of mass - t * volume until it falls to ``em_until``; mv the
    volume of the smallest region that holds alpha of the rows, alpha from 0.9 to 0.999. Input is
    (detector, score), anomaly scores. Only where a row falls among the uniform points matters,
    so rows are counted by that place and the curves are taken from counts, at most two a point.
    """
    held = {r["detector"]: np.sort(-np.array(r["u"], float)) for r in uniform.groupBy("detector").agg(F.collect_list("score").alias("u")).collect()}  # some thousand points a detector
    sent = scores.sparkSession.sparkContext.broadcast(held)

    def place(batches):
        for batch in batches:
            x, out = -batch["score"].to_numpy(float), np.zeros((2, len(batch)), np.int64)
            for name in batch["detector"].unique():
                own = (batch["detector"] == name).to_numpy()
                out[0, own], out[1, own] = (np.searchsorted(sent.value[name], x[own], side) for side in ("left", "right"))
            yield pd.DataFrame({"detector": batch["detector"], "x": x, "below": out[0], "upto": out[1]})

    each = scores.select("detector", "score").mapInPandas(place, "detector string, x double, below long, upto long")
    per = each.groupBy("detector", "below", "upto", "x").agg(F.count("*").alias("c"))
    per = per.groupBy("detector", "below", "upto").agg(F.sum("c").alias("c"), F.min(F.struct("x", "c"))["c"].alias("least"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["detector"].iloc[0]
        pdf, size = pdf.sort_values(["below", "upto"]), len(sent.value[name])
        c, n = pdf["c"].to_numpy(), pdf["c"].sum()
        above = c[::-1].cumsum()[::-1] - c  # rows in higher places
        mass, volume = (above + c - pdf["least"].to_numpy()) / n, (size - pdf["upto"].to_numpy()) / size
        t = np.linspace(0, t_most, steps)
        em = np.maximum(0, (mass[None] - t[:, None] * volume[None]).max(1))
        em[0] = max(em[0], 1.0)
        end = int(np.argmax(em <= em_until)) or steps - 1
        alpha = np.linspace(0.9, 0.999, steps)
        order = np.array([min(n, next(r for r in (int(np.ceil(a * n)) - 1, int(np.ceil(a * n)), int(np.ceil(a * n)) + 1) if r >= 1 and r / n >= a)) for a in alpha])
        # a point counts if fewer than ``order`` rows lie above it
        rows_above = n - np.concatenate([[0], c.cumsum()])[np.searchsorted(pdf["below"].to_numpy(), np.arange(size), "right")]
        mv = np.array([(rows_above < r).sum() / size for r in order])
        return pd.DataFrame({"detector": [name], "em": [np.trapezoid(em[: end + 1], t[: end + 1])], "mv": [np.trapezoid(mv, alpha)]})

    return per.groupBy("detector").applyInPandas(run, "detector string, em double, mv double")


def mv_curve(scores: DataFrame, uniform: DataFrame, levels: list[float]) -> DataFrame:
    """(alpha, threshold, volume): share of the uniform points at or above the normality that keeps the mass ``alpha``. ``score`` is normality."""
    cut = quantiles(scores, [], "score", [1.0 - a for a in levels]).select(F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("alpha"), F.col("q").alias("threshold"))).alias("z")).select("z.*")
    return uniform.join(F.broadcast(cut)).groupBy("alpha", "threshold").agg(F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("volume"))


def mean_ranks(scores: DataFrame) -> DataFrame:
    """(detector, id, r): ascending mean ranks, from counts per distinct score (see ``tails``), so no task orders all rows."""
    t = tails(stored(scores.select("id", F.lit(True).alias("train"), F.col("detector").alias("dim"), F.col("score").alias("x")), "scores"))
    # counts at most and at least x are le and ge, so the ties' mean rank is (le - ge + m + 1) / 2
    return t.select(F.col("dim").alias("detector"), "id", (F.round((F.col("le") - F.col("ge")) * F.col("m") + F.col("m") + 1) / 2).alias("r"))


def rank_agreement(scores: DataFrame) -> DataFrame:
    """(a, b, rho) for pairs of detectors: Pearson of their mean ranks. ``scores``: (detector, id, score)."""
    r = stored(mean_ranks(scores), "ranks")
    pairs = r.select("id", F.col("detector").alias("a"), F.col("r").alias("x")).join(r.select("id", F.col("detector").alias("b"), F.col("r").alias("y")), "id").where("a <> b")
    out = pairs.groupBy("a", "b").agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return out.select("a", "b", ratio(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))).alias("rho"))


def centrality(scores: DataFrame) -> DataFrame:
    """(detector, centrality): mean agreement with the other detectors."""
    return rank_agreement(scores).groupBy(F.col("a").alias("detector")).agg(F.avg("rho").alias("centrality"))


def consensus(scores: DataFrame, pool: Column | None = None) -> DataFrame:
    """(detector, consensus): Pearson of a detector's ranks with the ranks of the mean ranks of all.

    Of several data sets ``pool`` (an expression on id) names an id's own; detectors then have names of their own in each.
    """
    r = stored(mean_ranks(scores), "ranks")
    mean = r.groupBy("id").agg(F.round(F.avg("r"), 9).alias("score")).withColumn("detector", F.lit("") if pool is None else pool.cast("string"))
    out = r.join(mean_ranks(mean).select("id", F.col("r").alias("m")), "id").groupBy("detector").agg(F.covar_pop("r", "m").alias("c"), F.var_pop("r").alias("vr"), F.var_pop("m").alias("vm"))
    return out.select("detector", ratio(F.col("c"), F.sqrt(F.col("vr") * F.col("vm"))).alias("consensus"))


def standard_scores(scores: DataFrame) -> DataFrame:
    """``scores`` (detector, id, score) with n (rows of the detector) and z, from a row of sums per detector."""
    of = scores.groupBy(F.col("detector").alias("__d")).agg(F.avg("score").alias("__m"), F.stddev_pop("score").alias("__s"), F.count("*").alias("n"))
    return scores.join(of, F.col("detector") == F.col("__d")).withColumn("z", (F.col("score") - F.col("__m")) / (F.col("__s") + 1e-12)).drop("__d", "__m", "__s")


def z_consensus(scores: DataFrame) -> DataFrame:
    """(detector, consensus): Spearman of each detector with the mean of all standardised scores."""
    from ..functions.metrics import spearman

    scores = stored(scores, "scores")
    mean = standard_scores(scores).groupBy("id").agg(F.avg("z").alias("m"))
    return spearman(scores.join(mean, "id"), ["detector"], "score", "m").select("detector", F.col("rho").alias("consensus"))


def hits_authority(scores: DataFrame, rounds: int = 100) -> DataFrame:
    """(detector, authority): power iteration on the agreement matrix of the panel (detectors squared, on the driver)."""
    pairs = rank_agreement(scores).collect()  # a row per pair of the panel
    names = sorted({p["a"] for p in pairs})
    m = np.zeros((len(names), len(names)))
    for p in pairs:
        m[names.index(p["a"]), names.index(p["b"])] = max(0.0, p["rho"] or 0.0)
    a = np.ones(len(names))
    for _ in range(rounds):
        a = m.T @ (m @ a)
        a = a / (np.linalg.norm(a) or 1.0)
    return scores.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(names, a, strict=True)], "detector string, authority double")
