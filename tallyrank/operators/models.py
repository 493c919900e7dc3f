"""Detectors as model tables: ``fit`` makes a detector's model, ``score`` joins rows to it.

Rows are (task, id, v): a task is a data set, a pseudo-task or a configuration, and all tasks of a
table are fitted in one job. A model is one or more tables keyed by task (means, bins, counts
of distinct values, components, centres, trees), so it can be written, read in another session and
joined to any rows. Work that needs matrices runs on blocks of rows, a task's matrices in tasks; nothing
but numbers of rounds reaches the driver.

Defined results: a row whose task has no model has no score; dims that are constant in training count
nothing for hbos and severity and have scale 1 for the rest; rows of equal id are scored each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import numbered, running
from ..functions.ranks import hash_order
from ..functions.scratch import scratch, stored
from . import near
from .near import blocked, matrix

Tables = dict[str, DataFrame]


def points_of(rows: DataFrame) -> DataFrame:
    """Long (task, id, dim, x)."""
    return rows.select("task", "id", F.posexplode("v").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def _kind(rows: DataFrame) -> str:
    return rows.schema["task"].dataType.simpleString()


def _moments_table(train: DataFrame) -> Tables:
    return {"dims": points_of(train).groupBy("task", "dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))}


def _max_z(rows: DataFrame, model: Tables) -> DataFrame:
    z = F.abs((F.col("x") - F.col("mu")) / (F.col("sd") + 1e-9))
    return points_of(rows).join(model["dims"], ["task", "dim"]).groupBy("task", "id").agg(F.max(z).alias("score"))


def _centroid(rows: DataFrame, model: Tables) -> DataFrame:
    gap = F.col("x") - F.col("mu")
    return points_of(rows).join(model["dims"], ["task", "dim"]).groupBy("task", "id").agg(F.sqrt(F.sum(gap * gap)).alias("score"))


def _bin(bins: int):
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).cast("int")


def histogram_table(points: DataFrame, bins: int) -> DataFrame:
    """(task, dim, lo, hi, shares): the share of the rows in each of ``bins`` equal widths; constant dims are left out."""
    edges = points.groupBy("task", "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("m")).where("hi > lo")
    counts = points.join(edges, ["task", "dim"]).groupBy("task", "dim", "lo", "hi", "m", _bin(bins).alias("bin")).agg(F.count("*").alias("c"))
    known = counts.groupBy("task", "dim", "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", (F.col("c") / F.col("m")).alias("share")))).alias("of"))  # ``bins`` entries
    return known.select("task", "dim", "lo", "hi", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0.0))).alias("shares"))


def _hbos_sum(points: DataFrame, table: DataFrame, bins: int) -> DataFrame:
    """(task, id, score): surprise of each row's bins by density."""
    density = F.get("shares", _bin(bins)) / ((F.col("hi") - F.col("lo")) / bins)
    return points.join(table, ["task", "dim"]).groupBy("task", "id").agg(F.sum(-F.log2(density + 1e-9)).alias("score"))


HBOS, SEVERITY, LODA = 20, 30, 20


def value_table(points: DataFrame) -> DataFrame:
    """(task, dim, x, c, m, skew): counts of distinct training values, with the number of rows and the sign of the skew."""
    counts = points.groupBy("task", "dim", "x").agg(F.count("*").alias("c"))
    mean = points.groupBy("task", "dim").agg(F.avg("x").alias("mu"), F.count("*").alias("m"))
    gap = F.col("x") - F.col("mu")
    skew = points.join(mean, ["task", "dim"]).groupBy("task", "dim", "m").agg(F.signum(F.sum(gap * gap * gap)).alias("skew"))
    return counts.join(skew, ["task", "dim"])


def places(points: DataFrame, table: DataFrame) -> DataFrame:
    """``points`` with le and ge (training values at most and at least x), m and skew: a running sum over the values of both."""
    both = table.select("task", "dim", "x", "c").union(points.select("task", "dim", "x", F.lit(0).cast("long").alias("c"))).groupBy("task", "dim", "x").agg(F.sum("c").alias("c"))
    at = running(both, ["task", "dim"], ["x"], {"le": F.col("c")}, own=True)
    dims = table.select("task", "dim", "m", "skew").distinct()
    return points.join(at, ["task", "dim", "x"]).join(dims, ["task", "dim"]).withColumn("ge", F.col("m") - F.col("le") + F.col("c"))


def _tails(rows: DataFrame, model: Tables) -> DataFrame:
    at = places(points_of(rows), model["values"])
    share = lambda c: -F.log(F.greatest(F.col(c) / F.col("m"), F.lit(0.5) / F.col("m")))
    return at.select("task", "id", "skew", share("le").alias("l"), share("ge").alias("r"))


def _ecod(rows: DataFrame, model: Tables) -> DataFrame:
    auto = F.when(F.col("skew") < 0, F.col("l")).otherwise(F.col("r"))
    return _tails(rows, model).groupBy("task", "id").agg(F.greatest(F.sum("l"), F.sum("r"), F.sum(auto)).alias("score"))


def _copod(rows: DataFrame, model: Tables) -> DataFrame:
    skewed = F.when(F.col("skew") < 0, F.col("l")).when(F.col("skew") > 0, F.col("r")).otherwise(F.col("l") + F.col("r"))
    return _tails(rows, model).groupBy("task", "id").agg(F.sum(F.greatest(skewed, (F.col("l") + F.col("r")) / 2)).alias("score"))


def _severity(rows: DataFrame, model: Tables) -> DataFrame:
    at = places(points_of(rows), model["values"]).join(model["bins"], ["task", "dim"])
    le = F.col("le") / F.col("m")
    tail = -F.log(F.greatest(2 * F.least(le, 1 - le), F.lit(0.5) / F.col("m")))
    own = -F.log(F.get("shares", _bin(SEVERITY)) + 1e-9)
    found = at.groupBy("task", "id").agg(F.greatest(F.max(F.greatest(tail, own)), F.lit(0.0)).alias("score"))
    tasks = model["values"].select("task").distinct()
    return rows.select("task", "id").distinct().join(tasks, "task").join(found, ["task", "id"], "left").select("task", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _rows_table(train: DataFrame) -> Tables:
    return {"rows": train.select("task", "id", "v")}


def _knn(k: int, mean: bool):
    def score(rows: DataFrame, model: Tables) -> DataFrame:
        found = near.nearest(rows, model["rows"], k, same=False)
        if mean:
            return found.groupBy("task", "id").agg(F.avg("distance").alias("score"))
        return found.where(F.col("rank") == k).select("task", "id", F.col("distance").alias("score"))

    return score


LOF = 10


def _reach(found: DataFrame, model_rows: DataFrame) -> DataFrame:
    """(task, id, lrd): inverse mean reachability of the neighbours."""
    return found.join(model_rows, ["task", "other"]).groupBy("task", "id").agg((1 / (F.avg(F.greatest("distance", "kd")) + 1e-10)).alias("lrd"))


def _lof_fit(train: DataFrame) -> Tables:
    found = stored(near.nearest(train, train, LOF), "lof-neighbours")
    kd = found.where(F.col("rank") == LOF).select("task", F.col("id").alias("other"), F.col("distance").alias("kd"))
    return {"rows": train.select("task", "id", "v"), "density": kd.join(_reach(found, kd).withColumnRenamed("id", "other"), ["task", "other"])}


def _lof(rows: DataFrame, model: Tables) -> DataFrame:
    found = stored(near.nearest(rows, model["rows"], LOF, same=False), "lof-neighbours")
    own = _reach(found, model["density"])
    other = model["density"].select("task", "other", F.col("lrd").alias("lrd_other"))
    return found.join(other, ["task", "other"]).join(own, ["task", "id"]).groupBy("task", "id").agg(F.avg(F.col("lrd_other") / F.col("lrd")).alias("score"))


def moments(rows: DataFrame, finish: Callable[[int, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """(task, what ``finish`` makes of n, mean and population covariance): sums of d and d * d numbers a block and task."""
    kind = _kind(rows)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                m = matrix(r.m, len(r.ids))
                flat = np.concatenate([m.sum(axis=0), (m.T @ m).ravel()])
                yield pd.DataFrame({"task": r.task, "n": len(m), "i": np.arange(len(flat)), "x": flat})

    def by_task(pdf: pd.DataFrame) -> pd.DataFrame:
        flat, n = pdf.sort_values("i")["x"].to_numpy(), int(pdf["n"].iloc[0])
        d = int((-1 + np.sqrt(1 + 4 * len(flat))) / 2)
        mean = flat[:d] / n
        return pd.DataFrame([{"task": pdf["task"].iloc[0]} | finish(n, mean, flat[d:].reshape(d, d) / n - np.outer(mean, mean))])

    parts = blocked(rows).mapInPandas(sums, f"task {kind}, n long, i int, x double")
    return parts.groupBy("task", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).groupBy("task").applyInPandas(by_task, f"task {kind}, {schema}")  # d * d numbers


def _on_blocks(rows: DataFrame, table: DataFrame, f, columns: str = "score double") -> DataFrame:
    """(task, id, columns): ``f`` (matrix of a block, model row) joined by task; ``f`` gives a list of columns."""
    kind, names = _kind(rows), [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame({"task": r.task, "id": r.ids, **dict(zip(names, f(matrix(r.m, len(r.ids)), r), strict=True))})

    return blocked(rows.select("task", "id", "v")).join(table, "task").mapInPandas(run, f"task {kind}, id long, {columns}")


def _principal(cov: np.ndarray, share: float | None = None, most: int | None = None):
    from .detectors import components

    return components(cov, share, most)


def _pca_fit(train: DataFrame) -> Tables:
    def finish(n, mean, cov):
        values, vectors = _principal(cov)
        good = values > 1e-9 * max(values[0], 1e-300)
        return {"mean": mean, "vectors": vectors[:, good].ravel(), "scale": values[good]}

    return {"components": moments(train, finish, "mean array<double>, vectors array<double>, scale array<double>")}


def _pca(rows: DataFrame, model: Tables) -> DataFrame:
    return _on_blocks(rows, model["components"], lambda m, r: [(((m - r.mean) @ matrix(r.vectors, len(r.mean))) ** 2 / r.scale).sum(axis=1)])


def _residual_fit(train: DataFrame, alpha: float = 1.0, most: int = 120) -> Tables:
    def finish(n, mean, cov):
        d = len(mean)
        if d < 2 or d > most:
            return {"mean": mean, "coef": None, "sd": None}
        coef, sd = np.zeros((d, d)), np.zeros(d)
        for j in range(d):
            rest = np.arange(d) != j
            w = np.linalg.solve(n * cov[np.ix_(rest, rest)] + alpha * np.eye(d - 1), n * cov[rest, j])
            coef[rest, j] = w
            sd[j] = np.sqrt(max(cov[j, j] - 2 * w @ cov[rest, j] + w @ cov[np.ix_(rest, rest)] @ w, 0))
        return {"mean": mean, "coef": coef.ravel(), "sd": sd}

    return {"regressions": moments(train, finish, "mean array<double>, coef array<double>, sd array<double>")}


def _residual(rows: DataFrame, model: Tables) -> DataFrame:
    def score(m, r):
        if r.coef is None:
            return [np.full(len(m), np.nan)]
        return [(np.abs((m - r.mean) - (m - r.mean) @ matrix(r.coef, len(r.mean))) / (r.sd + 1e-9)).max(axis=1)]

    return _on_blocks(rows, model["regressions"], score).withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def _loda_fit(train: DataFrame, cuts: int = 50, seed: int = 0) -> Tables:
    def finish(n, mean, cov):
        d, rng = len(mean), np.random.default_rng(seed)
        w = np.zeros((d, cuts))
        for j in range(cuts):
            pick = rng.choice(d, max(1, int(np.sqrt(d))), replace=False)
            w[pick, j] = rng.standard_normal(len(pick))
        return {"mean": mean, "w": w.ravel(), "cuts": cuts}

    table = stored(moments(train, finish, "mean array<double>, w array<double>, cuts int"), "loda-projections")
    return {"projections": table, "bins": histogram_table(points_of(_projected(train, table)), LODA)}


def _projected(rows: DataFrame, table: DataFrame) -> DataFrame:
    return _on_blocks(rows, table, lambda m, r: [list((m - r.mean) @ matrix(r.w, len(r.mean)))], "v array<double>")


def _loda(rows: DataFrame, model: Tables) -> DataFrame:
    summed = _hbos_sum(points_of(_projected(rows, model["projections"])), model["bins"], LODA)
    return summed.join(model["projections"].select("task", "cuts"), "task").select("task", "id", (F.col("score") / F.col("cuts")).alias("score"))


def kmeans(rows: DataFrame, ks: DataFrame, rounds: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((task, k, id, cluster), (task, k, n, centres)): Lloyd rounds of all tasks and numbers of clusters together.

    ``ks``: (task, k). The first centres are the k rows of the least hashes; a cluster that
    loses its rows keeps its centre. A round sends a task's centres to its blocks and brings back
    sums per cluster. It ends when no centre moves, after ``rounds`` at most.
    """
    kind = _kind(rows)
    order = numbered(rows.withColumn("h", hash_order(F.lit(seed), F.lit("centre"), "id")), ["task"], ["h", "id"], "pos", "hash-order")
    first = order.join(ks, "task").where(F.col("pos") < F.col("k")).groupBy("task", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("z"))
    flat = lambda c: F.flatten(F.transform(c, lambda x: x["v"])).alias("centres")
    centres = stored(first.select("task", "k", F.size("z").alias("n"), flat("z")), "centres")
    blocks = stored(blocked(rows), "blocks")

    def assigned(r):
        m = matrix(r.m, len(r.ids))
        return m, near.distances(m, matrix(r.centres, r.n)).argmin(axis=1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                m, own = assigned(r)
                total = np.zeros((r.n, m.shape[1]))
                np.add.at(total, own, m)
                count = np.bincount(own, minlength=r.n)
                at, dim = np.nonzero(np.repeat(count[:, None] > 0, m.shape[1], axis=1))
                yield pd.DataFrame({"task": r.task, "k": r.k, "cluster": at, "dim": dim, "s": total[at, dim], "c": count[at]})

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame({"task": r.task, "k": r.k, "id": r.ids, "cluster": assigned(r)[1]})

    for _ in range(rounds):
        moved = blocks.join(centres, "task").mapInPandas(sums, f"task {kind}, k int, cluster int, dim int, s double, c long")
        moved = moved.groupBy("task", "k", "cluster", "dim").agg((F.sum("s") / F.sum("c")).alias("x"))
        moved = moved.groupBy("task", "k", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda x: x["x"]).alias("to"))
        size = F.size("centres") / F.col("n")
        old = centres.select("task", "k", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("centres", (i * size + 1).cast("int"), size.cast("int")))).alias("cluster", "own"))
        both = old.join(moved, ["task", "k", "cluster"], "left").withColumn("v", F.coalesce("to", "own"))
        gap = F.aggregate(F.zip_with("v", "own", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
        centres = stored(both.groupBy("task", "k", "n").agg(F.array_sort(F.collect_list(F.struct("cluster", "v"))).alias("z"), F.max(gap).alias("gap")).select("task", "k", "n", flat("z"), "gap"), "centres")
        still = centres.where("gap > 1e-9").isEmpty()
        centres = centres.drop("gap")
        if still:
            break
    return blocks.join(centres, "task").mapInPandas(labels, f"task {kind}, k int, id long, cluster int"), centres


def _cblof_fit(train: DataFrame, k: int = 8, alpha: float = 0.9, beta: float = 5.0) -> Tables:
    kind = _kind(train)
    sizes = train.groupBy("task").agg(F.least(F.lit(k), F.count("*")).cast("int").alias("k"))
    label, centres = kmeans(train, sizes)
    counts = label.groupBy("task", "cluster").agg(F.count("*").alias("c")).groupBy("task").agg(F.collect_list(F.struct("cluster", "c")).alias("z"))  # k entries
    table = centres.join(counts, "task").select("task", "n", "centres", F.transform("z", lambda x: x["cluster"]).alias("clusters"), F.transform("z", lambda x: x["c"]).alias("counts"))

    def large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                size = dict(zip(map(int, r.clusters), map(int, r.counts), strict=True))
                order, total, keep, run = sorted(size, key=lambda c: (-size[c], c)), sum(size.values()), [], 0
                for i, c in enumerate(order):
                    keep.append(c)
                    run += size[c]
                    after = size[order[i + 1]] if i + 1 < len(order) else 0
                    if run >= alpha * total or (after and size[c] / after >= beta):
                        break
                yield pd.DataFrame({"task": [r.task], "n": [len(keep)], "centres": [matrix(r.centres, r.n)[keep].ravel()]})

    return {"centres": table.mapInPandas(large, f"task {kind}, n int, centres array<double>")}


def _cblof(rows: DataFrame, model: Tables) -> DataFrame:
    return _on_blocks(rows, model["centres"], lambda m, r: [near.distances(m, matrix(r.centres, r.n)).min(axis=1)])


#: Rows that a tree is grown on, and trees that are grown together.
SUBSAMPLE, TREES_A_TASK = 256, 20


def average_path(n):
    """Mean depth of a row in a random tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)))


def trees(train: DataFrame, configs: DataFrame) -> DataFrame:
    """(task, features, seed, tree, size, feature, cut, below, above, depth): isolation trees as arrays of nodes, a row a tree.

    ``configs``: (features, seed, trees). ``TREES_A_TASK`` trees are a group, each grown on a
    hash sample of ``SUBSAMPLE`` training rows without replacement and that share of the dims.
    Forests of fewer trees are the first of these.
    """
    kind = _kind(train)
    placed = stored(numbered(train.withColumn("h", hash_order(F.lit("tree"), "id")), ["task"], ["h", "id"], "pos", "hash-order").drop("h"), "tree-rows")
    sizes = placed.groupBy("task").agg(F.count("*").alias("n"))
    each = sizes.join(F.broadcast(configs)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))  # a list of configurations
    u = lambda p: F.conv(F.substring(F.md5(F.concat_ws(":", "seed", "features", "tree", p)), 1, 12), 16, 10).cast("double") / float(1 << 48)
    some = F.slice(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4 * SUBSAMPLE - 1)), lambda j: F.floor(u(j) * F.col("n")))), 1, SUBSAMPLE)
    every = F.slice(F.transform(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda p: F.struct(u(p).alias("u"), p.alias("p")))), lambda x: x["p"]), 1, SUBSAMPLE)
    wanted = each.select("task", "features", "seed", "tree", F.explode(F.when(F.col("n") <= 8 * SUBSAMPLE, every).otherwise(some)).alias("pos"))

    def grown(data: np.ndarray, features: float, seed: int, tree: int) -> dict:
        rng = np.random.default_rng([seed, int(round(features * 1000)), tree])
        dims, limit = data.shape[1], int(np.ceil(np.log2(max(len(data), 2))))
        dims = np.arange(dims) if features >= 1 else rng.choice(dims, max(1, int(features * dims)), replace=False)
        draw = iter(rng.random(6 * len(data) + 6).tolist())
        feature, cut, below, above, depth = [], [], [], [], []

        def node(m, at):
            i, n = len(feature), len(m)
            for out, v in ((feature, -1), (cut, 0.0), (below, -1), (above, -1), (depth, at + paths[n])):
                out.append(v)
            if at < limit and n > 1:
                j = dims[int(next(draw) * len(dims))]
                x = m[:, j]
                low, high = x.min(), x.max()
                if low == high:  # one of the dims that aren't constant here, if any
                    span = dims[m[:, dims].max(axis=0) > m[:, dims].min(axis=0)]
                    if not len(span):
                        return i
                    j = span[int(next(draw) * len(span))]
                    x = m[:, j]
                    low, high = x.min(), x.max()
                feature[i], cut[i] = int(j), float(low + next(draw) * (high - low))
                under = x < cut[i]
                below[i] = node(m[under], at + 1)
                above[i] = node(m[~under], at + 1)
            return i

        paths = average_path(np.arange(len(data) + 1)).tolist()
        node(data, 0)
        return {"features": features, "seed": seed, "tree": tree, "size": len(data), "feature": feature, "cut": cut, "below": below, "above": above, "depth": depth}

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, own in pdf.sort_values(["tree", "pos"]).groupby("tree"):
            out.append({"task": own["task"].iloc[0]} | grown(np.array(own["v"].tolist(), float), float(own["features"].iloc[0]), int(own["seed"].iloc[0]), int(tree)))
        return pd.DataFrame(out)

    rows = wanted.join(placed, ["task", "pos"]).select("task", "features", "seed", "tree", "pos", "v")
    some_trees = ["task", "features", "seed", F.floor(F.col("tree") / TREES_A_TASK)]
    return rows.groupBy(*some_trees).applyInPandas(grow, f"task {kind}, features double, seed int, tree int, size int, feature array<int>, cut array<double>, below array<int>, above array<int>, depth array<double>")


def forest_scores(rows: DataFrame, table: DataFrame, counts: list[int]) -> DataFrame:
    """(task, id, features, seed, trees, score) for forests of the first ``counts`` trees of ``table``.

    Forests of one configuration travel as one row; a block of rows walks its trees once for all counts.
    """
    kind, counts = _kind(rows), sorted(counts)
    parts = ("size", "feature", "cut", "below", "above", "depth")
    forests = table.groupBy("task", "features", "seed").agg(F.array_sort(F.collect_list(F.struct("tree", *parts))).alias("z"))
    forests = forests.select("task", "features", "seed", *(F.col(f"z.{c}").alias(c) for c in parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                m, total = matrix(r.m, len(r.ids)), np.zeros(len(r.ids))
                for t in range(len(r.feature)):
                    feature, cut, below, above = (np.asarray(x[t]) for x in (r.feature, r.cut, r.below, r.above))
                    at = np.zeros(len(m), np.int64)
                    while (inner := np.flatnonzero(feature[at] >= 0)).size:
                        now = at[inner]
                        at[inner] = np.where(m[inner, feature[now]] < cut[now], below[now], above[now])
                    total += np.asarray(r.depth[t])[at]
                    if t + 1 in counts:
                        score = 2 ** (-total / (t + 1) / max(float(average_path(r.size[t])), 1e-12))
                        yield pd.DataFrame({"task": r.task, "id": r.ids, "features": r.features, "seed": r.seed, "trees": t + 1, "score": score})

    return blocked(rows.select("task", "id", "v")).join(forests, "task").mapInPandas(run, f"task {kind}, id long, features double, seed int, trees int, score double")


FOREST = 100


def _forest_fit(train: DataFrame) -> Tables:
    return {"trees": trees(train, train.sparkSession.createDataFrame([(1.0, 0, FOREST)], "features double, seed int, trees int"))}


def _forest(rows: DataFrame, model: Tables) -> DataFrame:
    return forest_scores(rows, model["trees"], [FOREST]).select("task", "id", "score")


@dataclass(frozen=True)
class Detector:
    """``fit`` (rows) gives the model's tables, ``score`` (rows, tables) gives (task, id, score)."""

    fit: Callable[[DataFrame], Tables]
    score: Callable[[DataFrame, Tables], DataFrame]


DETECTORS = {
    "maxz": Detector(_moments_table, _max_z),
    "centroid": Detector(_moments_table, _centroid),
    "hbos": Detector(lambda t: {"bins": histogram_table(points_of(t), HBOS)}, lambda r, m: _hbos_sum(points_of(r), m["bins"], HBOS)),
    "ecod": Detector(lambda t: {"values": value_table(points_of(t))}, _ecod),
    "copod": Detector(lambda t: {"values": value_table(points_of(t))}, _copod),
    "severity": Detector(lambda t: {"values": value_table(points_of(t)), "bins": histogram_table(points_of(t), SEVERITY)}, _severity),
    "knn": Detector(_rows_table, _knn(5, False)),
    "knn_mean": Detector(_rows_table, _knn(10, True)),
    "lof": Detector(_lof_fit, _lof),
    "pca": Detector(_pca_fit, _pca),
    "iforest": Detector(_forest_fit, _forest),
    "loda": Detector(_loda_fit, _loda),
    "cblof": Detector(_cblof_fit, _cblof),
    "linear_residual": Detector(_residual_fit, _residual),
}


def _rows(rows: DataFrame, name: str, kept: bool) -> DataFrame:
    rows = rows.select("task", F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    return rows if kept else stored(rows, name)


def fit(train: DataFrame, names, path: str | None = None, kept: bool = False) -> str:
    """Fits detectors on ``train`` (task, id, v) and writes their models below ``path`` (default: a fresh scratch folder), which is returned.

    ``kept``: the rows are read from a table, so they aren't stored again.
    """
    path = path or scratch(train.sparkSession, "models")
    train = _rows(train, "training-rows", kept)
    for name in names:
        for part, table in DETECTORS[name].fit(train).items():
            table.write.parquet(f"{path}/{name}/{part}")
    return path


def load(spark: SparkSession, path: str, name: str) -> Tables:
    parts = {  # the tables of each detector's model
        "maxz": ["dims"], "centroid": ["dims"], "hbos": ["bins"], "ecod": ["values"], "copod": ["values"], "severity": ["values", "bins"], "knn": ["rows"], "knn_mean": ["rows"], "lof": ["rows", "density"],
        "pca": ["components"], "iforest": ["trees"], "loda": ["projections", "bins"], "cblof": ["centres"], "linear_residual": ["regressions"],
    }
    return {part: spark.read.parquet(f"{path}/{name}/{part}") for part in parts[name]}


def score(rows: DataFrame, path: str, names, kept: bool = False) -> DataFrame:
    """(task, detector, id, score) of ``rows`` (task, id, v) under the models written to ``path``. ``kept``: see ``fit``."""
    rows = _rows(rows, "rows-to-score", kept)
    out = None
    for name in names:
        own = DETECTORS[name].score(rows, load(rows.sparkSession, path, name)).select("task", F.lit(name).alias("detector"), "id", "score")
        out = own if out is None else out.union(own)
    return out
