"""Detectors by name: fitted on one table, scoring others; and the evaluators built on that.

Tables of rows are (id, v) with a long id and a vector of doubles. A detector is a function of one
table with a boolean ``train``; here training and scored rows are told apart by their ids, so
each detector reads both in one pass. Fitting and scoring apart, and many data sets or tasks at once, go by
the model tables of ``models``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import average_precision, partial_auc, roc_auc
from ..functions.ranks import hash_order, hash_unit
from ..functions.scratch import stored
from . import detectors as det
from . import models
from .splits import candidates, draws, shuffled_features

LONG = {"maxz": det.max_z, "centroid": det.centroid_distance, "hbos": det.hbos, "ecod": det.ecod, "copod": det.copod, "severity": det.severity}
WIDE = {
    "knn": det.knn, "knn_mean": det.knn_mean, "lof": det.lof, "pca": det.pca_score, "iforest": det.isolation_forest, "loda": det.loda, "cblof": det.cblof,
    "linear_residual": det.linear_residual,
}
PANEL = ("maxz", "centroid", "hbos", "ecod", "severity")


def panel(keep: list[str] | None = None, leave_out: list[str] = ()) -> list[str]:
    """Names of detectors: those of ``keep`` (default all) that aren't in ``leave_out``."""
    return [n for n in [*LONG, *WIDE] if (keep is None or n in keep) and n not in leave_out]


def fit_scores(train: DataFrame, rows: DataFrame, names: tuple[str, ...] = PANEL) -> DataFrame:
    """(detector, id, score) of ``rows`` under detectors fitted on ``train``; both (id, v). The models are stored in between (see ``models``)."""
    one = lambda t: t.select(F.lit(0).alias("task"), "id", "v")
    return models.score(one(rows), models.fit(one(train), names), names).drop("task")


def fit_tasks(rows: DataFrame, tasks: DataFrame, names: tuple[str, ...] = PANEL) -> DataFrame:
    """(task, detector, auc): each task's detectors, fitted on its training rows, on its own pseudo-anomalies against its held-out normals.

    ``rows``: (dataset, id, v); ``tasks``: (task, dataset, id, role) with the roles train, pnorm and panom. All
    tasks are fitted together. Scores of no spread, or not finite, give no AUC.
    """
    own = stored(rows.join(tasks, ["dataset", "id"]).select("task", "id", "v", "role"), "task-rows")
    scores = models.score(own.where("role <> 'train'").drop("role"), models.fit(own.where("role = 'train'").drop("role"), names, kept=True), names, kept=True)
    scores = stored(scores.withColumn("score", F.round("score", 9)), "task-scores")
    judged = scores.join(own.where("role <> 'train'").select("task", "id", (F.col("role") == "panom").cast("int").alias("y")), ["task", "id"])
    return roc_auc(det.guarded(judged, ["task", "detector"]).where("score is not null"), ["task", "detector"], "score", "y")


def task_scores(points: DataFrame, tasks: DataFrame, names: tuple[str, ...] = PANEL) -> DataFrame:
    """``fit_tasks`` of long points (id, dim, x) and ``tasks`` (task, id, role): (task, detector, auc)."""
    rows = vectors_of(points).select(F.lit(0).alias("dataset"), "id", "v")
    return fit_tasks(rows, tasks.select("task", F.lit(0).alias("dataset"), "id", "role"), names)


def uniform_box(rows: DataFrame, n: int, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, v): n points spread by hash over the box of ``rows``, for each value of ``by``; a constant dimension has span 1."""
    points = rows.select(*by, "id", F.posexplode("v").alias("dim", "x"))
    box = points.groupBy(*by, "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = box.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    x = F.col("lo") + hash_unit(F.lit(seed), "id", "dim") * F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    v = F.transform(F.array_sort(F.collect_list(F.struct("dim", x.alias("x")))), lambda p: p["x"])
    return at.groupBy(*by, "id").agg(v.alias("v"))


def vectors_of(points: DataFrame) -> DataFrame:
    """(id, v) of long points (id, dim, x)."""
    return points.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))


def evaluate(rows: DataFrame, names: tuple[str, ...] = PANEL, n_uniform: int = 10_000, seed: int = 0) -> DataFrame:
    """Per detector its ground truth on test rows and the criteria that need no label, taken on validation rows.

    ``rows``: (id, role, y, v) with the roles train, val and test (y: 1 for anomalies). Detectors
    with a score that isn't finite, or without spread, on either are left out; fewer than three
    left give no row.
    """
    tag = {"val": 0, "test": 1}
    judged = rows.where("role in ('val', 'test')").select((F.col("id") * 3 + F.when(F.col("role") == "val", tag["val"]).otherwise(tag["test"])).alias("id"), "v")
    uniform = uniform_box(rows.where("role = 'val'").select("id", "v"), n_uniform, seed).select((F.col("id") * 3 + 2).alias("id"), "v")
    scores = stored(fit_scores(rows.where("role = 'train'").select("id", "v"), judged.union(uniform), names), "panel-scores")
    scores = scores.select("detector", F.floor(F.col("id") / 3).cast("long").alias("id"), (F.col("id") % 3).alias("part"), F.round("score", 9).alias("score"))
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    sound = scores.where("part < 2").groupBy("detector", "part").agg(F.max(bad.cast("int")).alias("bad"), F.stddev_pop("score").alias("sd"))
    sound = sound.groupBy("detector").agg(F.max("bad").alias("bad"), F.min("sd").alias("sd")).where("bad = 0 and sd >= 1e-12")
    scores = scores.join(sound.select("detector", F.count("*").over(Window.partitionBy()).alias("n")).where("n >= 3").drop("n"), "detector")  # one row a detector
    val, test = (scores.where(F.col("part") == tag[p]).drop("part") for p in ("val", "test"))
    truth = test.join(rows.where("role = 'test'").select("id", "y"), "id")
    out = roc_auc(truth, ["detector"], "score", "y").join(partial_auc(truth, ["detector"], "score", "y").withColumnRenamed("pauc", "pauc10"), "detector")
    out = out.join(average_precision(truth, ["detector"], "score", "y"), "detector").join(det.goix(val, scores.where("part = 2")), "detector")
    return out.join(det.consensus(val), "detector").join(det.centrality(val), "detector").join(det.hits_authority(val).withColumnRenamed("authority", "hits"), "detector")


def synthetic_auc(train: DataFrame, val: DataFrame, synthetic: DataFrame, names: tuple[str, ...] = PANEL) -> DataFrame:
    """(detector, auc): detectors fitted on ``train``, on synthetic anomalies against validation normals."""
    rows = val.select((F.col("id") * 2).alias("id"), "v").union(synthetic.select((F.col("id") * 2 + 1).alias("id"), "v"))
    scores = fit_scores(train, rows, names).withColumn("score", F.round("score", 9))
    return roc_auc(det.guarded(scores, ["detector"]).where("score is not null").withColumn("y", (F.col("id") % 2).cast("int")), ["detector"], "score", "y")


def synthetic_auc_within(val: DataFrame, synthetic: DataFrame, names: tuple[str, ...] = PANEL, seed: int = 0) -> DataFrame:
    """The older form of ``synthetic_auc``: fitted on seven tenths of the validation rows by hash, judged on the rest."""
    mine = hash_unit(F.lit(seed), "id") < 0.7
    return synthetic_auc(val.where(mine), val.where(~mine), synthetic, names)


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(id, v): a synthetic anomaly of each row by feature shuffle."""
    return vectors_of(shuffled_features(det.long_form(rows.withColumn("train", F.lit(True))).select("id", "dim", "x"), seed))


#: Ways to choose clusters, by numbers of clusters: the bank of regimes.
REGIMES = [(how, k) for how in ("smallest", "random", "hard") for k in (30, 50)]


def effective_k(k, n):
    """Clusters that n rows allow: at least 20 rows each, two at least. Columns."""
    return F.least(k, F.greatest(F.lit(2), F.floor(n / 20))).cast("int")


def embedded(rows: DataFrame, most: int = 16) -> DataFrame:
    """(task, id, v): projections of each task's standardised rows on their leading components."""

    def finish(n, mean, cov):
        sd = np.sqrt(np.diag(cov))
        sd[sd == 0] = 1
        return {"mean": mean, "sd": sd, "vectors": det.components(cov / np.outer(sd, sd), most=most)[1].ravel()}

    table = models.moments(rows, finish, "mean array<double>, sd array<double>, vectors array<double>")
    return models._on_blocks(rows, table, lambda m, r: [list(((m - r.mean) / r.sd) @ r.vectors.reshape(len(r.mean), -1))], "v array<double>")


def cluster_tasks(labelled: DataFrame, m: int = 15, hows: tuple[str, ...] = ("smallest",), seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, how, draw, id, role): m tasks a clustering and way to choose, whose pseudo-anomalies are whole clusters.

    ``labelled``: long (id, cluster, dim, x) and the key columns ``by``. Of the other rows min(max(50, a fifth), a
    third), by hash, are held-out normals. Tasks of fewer than 3 pseudo-anomalies, 3 normals or 20
    training rows are left out.
    """
    by = list(by)
    key = F.concat_ws("|", *by, F.lit("")).alias("key")
    composite = stored(det.cluster_composite(labelled, by=tuple(by)).select(*by, key, "cluster", "size", "far_component", "composite"), "composites")
    of = lambda t, how: t.withColumn("dataset", F.concat_ws("|", "key", F.lit(how)))
    chosen = reduce(DataFrame.union, [candidates(of(composite, how), how).select("dataset", "cluster", "size") for how in hows])
    sizes = composite.groupBy("key").agg(F.sum("size").alias("n"))
    picked = stored(draws(chosen, reduce(DataFrame.union, [of(sizes, how).select("dataset", "n") for how in hows]), m, seed), "draws")
    once = stored(labelled.select(*by, key, "id", "cluster").distinct(), "cluster-ids")
    # draws are lists of clusters, so a row is told its part in each task where it is read; no row is stored or ordered a task
    out = picked.withColumn("out", F.lit(True))
    ids = once.withColumn("how", F.explode(F.array(*map(F.lit, hows)))).withColumn("dataset", F.concat_ws("|", "key", "how"))
    ids = ids.join(F.broadcast(picked.select("dataset", "draw").distinct()), "dataset").join(F.broadcast(out), ["dataset", "draw", "cluster"], "left")
    ids = ids.withColumn("h", F.when(F.col("out").isNull(), hash_order(F.lit(seed), F.lit("pnorm"), "dataset", "draw", "id")))
    # the held-out rows are those of the least hashes: a count by the hash's first digits finds where they end, and only rows there are ordered
    start = F.substring("h", 1, 3)
    starts = stored(ids.groupBy("dataset", "draw", start.alias("start")).agg(F.count("*").alias("c")), "task-counts")
    counts = starts.groupBy("dataset", "draw").agg(F.sum(F.when(F.col("start").isNotNull(), F.col("c"))).alias("c"), F.sum(F.when(F.col("start").isNull(), F.col("c"))).alias("a"))
    held = F.least(F.greatest(F.lit(50), F.floor(F.col("c") * 0.2)), F.floor(F.col("c") / 3))
    good = counts.select("dataset", "draw", held.alias("held"), "c").where((F.col("a") >= 3) & (F.col("held") >= 3) & (F.col("c") - F.col("held") >= 20))
    upto = F.sum("n").over(Window.partitionBy("dataset", "draw").orderBy("start"))  # 4096 rows at most
    ends = starts.where("start is not null").withColumnRenamed("c", "n").withColumn("upto", upto).join(good, ["dataset", "draw"])
    ends = ends.where("upto - n < held and held <= upto").select("dataset", "draw", F.col("start").alias("end"), (F.col("held") - F.col("upto") + F.col("n")).alias("rest"))
    last = ids.join(F.broadcast(ends), ["dataset", "draw"]).where(start == F.col("end"))
    last = last.withColumn("k", F.row_number().over(Window.partitionBy("dataset", "draw").orderBy("h", "id"))).where(F.col("k") == F.col("rest"))  # a 4096th of the rows
    last = stored(last.select("dataset", "draw", F.col("h").alias("last_h"), F.col("id").alias("last_id")), "held-out")
    kept = F.when(F.col("h") < F.col("last_h"), True).otherwise((F.col("h") == F.col("last_h")) & (F.col("id") <= F.col("last_id")))
    role = F.when(F.col("out").isNotNull(), "panom").when(kept, "pnorm").otherwise("train")
    return ids.join(F.broadcast(last), ["dataset", "draw"]).select(*by, "how", "draw", "id", role.alias("role"))


def pseudo_subsets(labelled: DataFrame, m: int = 15, how: str = "smallest", seed: int = 0) -> DataFrame:
    """(task, id, role): the tasks of one clustering and way to choose (see ``cluster_tasks``)."""
    return cluster_tasks(labelled, m, (how,), seed).select(F.col("draw").alias("task"), "id", "role")


def pseudo_fact(rows: DataFrame, names: tuple[str, ...] = PANEL, bank: list[tuple[str, int]] = REGIMES, m: int = 15, seed: int = 0) -> DataFrame:
    """(dataset, detector, regime, subset, pseudo_auc): the fact table of pseudo-tasks that rankings and voting schemes work on.

    ``rows``: (dataset, id, v) of normal rows. All data sets are embedded, clustered for all numbers of
    clusters, cut into tasks, fitted and judged together.
    """
    kind = rows.schema["dataset"].dataType.simpleString()
    rows = stored(rows.select("dataset", F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v")), "normal-rows")
    z = stored(embedded(rows.withColumnRenamed("dataset", "task")), "embedded")
    wanted = rows.sparkSession.createDataFrame(bank, "how string, nominal int")
    sizes = rows.groupBy(F.col("dataset").alias("task")).agg(F.count("*").alias("n"))
    wanted = stored(sizes.join(F.broadcast(wanted)).select("task", "how", "nominal", effective_k(F.col("nominal"), F.col("n")).alias("k")), "bank")  # a list of regimes
    labels, _ = models.kmeans(z, wanted.select("task", "k").distinct(), seed=seed)
    labelled = stored(labels.join(models.points_of(z), ["task", "id"]).select("task", "k", "id", "cluster", "dim", "x"), "clustered-rows")
    subsets = cluster_tasks(labelled, m, tuple(sorted({h for h, _ in bank})), seed, ("task", "k"))
    task = F.concat_ws("|", "k", "how", "draw", F.col("task").cast("string")).alias("task")
    aucs = fit_tasks(rows, subsets.select(task, F.col("task").alias("dataset"), "id", "role"), names)
    part = F.split("task", r"\|", 4)
    aucs = aucs.select(part[3].cast(kind).alias("task"), part[0].cast("int").alias("k"), part[1].alias("how"), part[2].cast("long").alias("subset"), "detector", F.col("auc").alias("pseudo_auc"))
    regime = F.concat(F.col("how"), F.lit("_K"), F.col("nominal").cast("string")).alias("regime")
    return aucs.join(wanted, ["task", "k", "how"]).select(F.col("task").alias("dataset"), "detector", regime, "subset", "pseudo_auc")


def manifold_separability(val: DataFrame, names: tuple[str, ...] = PANEL, m: int = 15, k: int = 50, how: str = "smallest", seed: int = 0) -> DataFrame:
    """(dataset, detector, auc): mean over pseudo-tasks of whole clusters of validation normals (dataset, id, v) held out. None below 60 rows."""
    enough = val.groupBy("dataset").agg(F.count("*").alias("n")).where("n >= 60").select("dataset")
    fact = pseudo_fact(val.join(enough, "dataset"), names, [(how, k)], m, seed)
    return fact.groupBy("dataset", "detector").agg(F.avg("pseudo_auc").alias("auc"))


def evaluate_all(rows: DataFrame, names: tuple[str, ...] = PANEL, n_uniform: int = 10_000, seed: int = 0) -> DataFrame:
    """``evaluate`` of many data sets in one job: (dataset, detector, auc, ap, base_rate, ap_norm, em, mv, consensus, centrality, hits, separability).

    ``rows``: (dataset, id, role, y, v). Excess mass and mass volume are those of thresholds over the pooled range.
    Detectors with a score that isn't finite, or without spread, are left out of a data set; a data set with fewer than three left goes.
    """
    rows = stored(rows.select("dataset", F.col("id").cast("long").alias("id"), "role", "y", F.transform("v", lambda x: x.cast("double")).alias("v")), "panel-rows")
    of = lambda role: rows.where(F.col("role") == role)
    tag = {"val": 0, "test": 1}
    judged = rows.where("role in ('val', 'test')").select(F.col("dataset").alias("task"), (F.col("id") * 3 + F.when(F.col("role") == "val", tag["val"]).otherwise(tag["test"])).alias("id"), "v")
    uniform = uniform_box(of("val"), n_uniform, seed, ("dataset",)).select(F.col("dataset").alias("task"), (F.col("id") * 3 + 2).alias("id"), "v")
    path = models.fit(of("train").select(F.col("dataset").alias("task"), "id", "v"), names)
    scores = models.score(judged.union(uniform), path, names).select(F.col("task").alias("dataset"), "detector", F.floor(F.col("id") / 3).cast("long").alias("id"), (F.col("id") % 3).alias("part"), F.round("score", 9).alias("score"))
    scores = stored(scores, "panel-scores")
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    sound = scores.where("part < 2").groupBy("dataset", "detector", "part").agg(F.max(bad.cast("int")).alias("bad"), F.stddev_pop("score").alias("sd"))
    sound = sound.groupBy("dataset", "detector").agg(F.max("bad").alias("bad"), F.min("sd").alias("sd")).where("bad = 0 and sd >= 1e-12")
    sound = sound.select("dataset", "detector", F.count("*").over(Window.partitionBy("dataset")).alias("n")).where("n >= 3").drop("n")  # a row a detector
    scores = stored(scores.join(sound, ["dataset", "detector"]), "sound-scores")
    key = ["dataset", "detector"]
    truth = scores.where("part = 1").join(of("test").select("dataset", "id", "y"), ["dataset", "id"])
    out = roc_auc(truth, key, "score", "y").join(average_precision(truth, key, "score", "y"), key)
    # a detector of a data set is one of its own for the criteria, and its rows' ids hold the data set
    names_of = scores.select(F.concat_ws("|", "detector", F.col("dataset").cast("string")).alias("detector"), F.struct("dataset", "id").alias("id"), "part", "score")
    val = stored(names_of.where("part = 0").drop("part"), "validation-scores")
    again = lambda t: t.join(sound.withColumn("d", F.concat_ws("|", "detector", F.col("dataset").cast("string"))).withColumnRenamed("detector", "own"), F.col("detector") == F.col("d")).drop("d", "detector").withColumnRenamed("own", "detector")
    pairs = stored(det.rank_agreement(val), "agreement")
    for part in (det.em_mv(val, names_of.where("part = 2")), det.consensus(val, F.col("id.dataset")), pairs.groupBy(F.col("a").alias("detector")).agg(F.avg("rho").alias("centrality"))):
        out = out.join(again(part), key, "left")
    out = out.join(hits_of(again(pairs.withColumnRenamed("a", "detector")).select("dataset", F.col("detector").alias("a"), F.substring_index("b", "|", 1).alias("b"), "rho")), key, "left")
    return out.join(manifold_separability(of("val"), names, seed=seed).withColumnRenamed("auc", "separability"), key, "left")


def hits_of(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(dataset, detector, hits): power iteration on each data set's agreement matrix, a task a panel. ``pairs``: (dataset, a, b, rho)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]))
        m = np.zeros((len(names), len(names)))
        for a, b, rho in zip(pdf["a"], pdf["b"], pdf["rho"], strict=True):
            m[names.index(a), names.index(b)] = max(0.0, rho) if rho == rho and rho is not None else 0.0
        x = np.ones(len(names))
        for _ in range(rounds):
            x = m.T @ (m @ x)
            x = x / (np.linalg.norm(x) or 1.0)
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], "detector": names, "hits": x})

    kind = pairs.schema["dataset"].dataType.simpleString()
    return pairs.groupBy("dataset").applyInPandas(run, f"dataset {kind}, detector string, hits double")  # detectors squared


def rule_auc(rows: DataFrame) -> DataFrame:
    """(dataset, rule_auc): the better AUC of max-z and the histogram rule, fitted on training rows, on test rows: what a rule alone would reach.

    ``rows``: (dataset, id, role, y, v).
    """
    part = lambda role: rows.where(F.col("role") == role).select(F.col("dataset").alias("task"), F.col("id").cast("long").alias("id"), "v")
    rules = ("maxz", "hbos")
    scores = models.score(part("test"), models.fit(part("train"), rules), rules).select(F.col("task").alias("dataset"), "detector", "id", F.round("score", 9).alias("score"))
    judged = stored(scores, "rule-scores").join(rows.where("role = 'test'").select("dataset", "id", "y"), ["dataset", "id"])
    return roc_auc(judged, ["dataset", "detector"], "score", "y").groupBy("dataset").agg(F.max("auc").alias("rule_auc"))


def fallback_labels(labels: DataFrame, other: DataFrame, least: int = 3) -> DataFrame:
    """(id, cluster): the labels if they name at least ``least`` clusters, else ``other`` (the gate on a deep clustering)."""
    n = labels.agg(F.count_distinct("cluster").alias("k"))
    return labels.join(F.broadcast(n.where(F.col("k") >= least))).select("id", "cluster").union(other.join(F.broadcast(n.where(F.col("k") < least))).select("id", "cluster"))  # one row


def _forest_grid(train: DataFrame, rows: DataFrame, features: tuple[float, ...], counts: tuple[int, ...], seeds: tuple[int, ...]) -> DataFrame:
    """(dataset, features, trees, seed, id, score): all forests of the grid; those of one share and seed have their trees in common."""
    one = lambda t: t.select(F.col("dataset").alias("task"), F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    configs = train.sparkSession.createDataFrame([(float(f), s, max(counts)) for f in features for s in seeds], "features double, seed int, trees int")
    table = stored(models.trees(one(train), configs), "grid-trees")
    scores = models.forest_scores(one(rows), table, list(counts))
    return stored(scores.select(F.col("task").alias("dataset"), "features", "trees", "seed", "id", F.round("score", 9).alias("score")), "grid-scores")


CONFIG = ["dataset", "features", "trees"]


def _config_ap(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(config, seed, ap_norm) of the sound forests."""
    judged = det.guarded(scores, [*CONFIG, "seed"]).where("score is not null").join(truth.select("dataset", "id", "y"), ["dataset", "id"])
    return average_precision(judged, [*CONFIG, "seed"], "score", "y").select(*CONFIG, "seed", "ap_norm")


def seed_stability(scores: DataFrame) -> DataFrame:
    """(config, stability): median Spearman over pairs of seeds of a forest configuration's scores (config, seed, id, score)."""
    sound = det.guarded(scores, [*CONFIG, "seed"]).where("score is not null")
    name = F.concat_ws("|", "features", "trees", "seed", F.col("dataset").cast("string"))
    named = stored(sound.select(name.alias("detector"), F.struct("dataset", "id").alias("id"), "score", "features", "trees", "seed"), "forest-scores")
    ranks = stored(det.mean_ranks(named.select("detector", "id", "score")), "forest-ranks")
    of = named.select("detector", "features", "trees", "seed").distinct()
    own = ranks.join(of, "detector").select(F.col("id.dataset").alias("dataset"), F.col("id.id").alias("id"), "features", "trees", "seed", "r")
    pairs = own.join(own.select("dataset", "id", "features", "trees", F.col("seed").alias("other"), F.col("r").alias("r2")), [*CONFIG, "id"]).where("seed < other")
    rho = pairs.groupBy(*CONFIG, "seed", "other").agg(F.corr("r", "r2").alias("rho"))
    return rho.groupBy(*CONFIG).agg(F.percentile("rho", F.lit(0.5)).alias("stability"))  # a value a pair of seeds


def most_stable(train: DataFrame, rows: DataFrame, truth: DataFrame, counts: tuple[int, ...] = (50, 100, 200), features: tuple[float, ...] = (0.5, 0.75, 1.0), seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(dataset, features, trees, stability, ap_norm, regret): the forest configuration whose scores depend least on the seed, and what it costs.

    ap_norm is the mean over the seeds, regret what the best configuration has above it. Of equal stabilities the
    smaller configuration is taken; data sets with fewer than four configurations go. ``truth``: (dataset, id, y).
    """
    scores = _forest_grid(train, rows, features, counts, seeds)
    ap = _config_ap(scores, truth).groupBy(*CONFIG).agg(F.avg("ap_norm").alias("ap_norm"))
    both = seed_stability(scores).join(ap, CONFIG)
    out = both.groupBy("dataset").agg(F.max(F.struct("stability", (-F.col("trees")).alias("t"), (-F.col("features")).alias("f"), "ap_norm")).alias("z"), F.max("ap_norm").alias("best"), F.count("*").alias("n"))
    return out.where("n >= 4").select("dataset", (-F.col("z.f")).alias("features"), (-F.col("z.t")).alias("trees"), "z.stability", "z.ap_norm", (F.col("best") - F.col("z.ap_norm")).alias("regret"))


#: 81 forests: numbers of trees by shares of the dims.
GRID_TREES, GRID_FEATURES = (10, 20, 30, 40, 50, 75, 100, 150, 200), (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def random_forest_choice(train: DataFrame, rows: DataFrame, truth: DataFrame, counts: tuple[int, ...] = GRID_TREES, features: tuple[float, ...] = GRID_FEATURES, least: int = 40) -> DataFrame:
    """(dataset, n, ap_norm, regret): what a forest chosen at random from the grid gives on average; none with fewer than ``least`` sound ones."""
    ap = _config_ap(_forest_grid(train, rows, features, counts, (0,)), truth)
    out = ap.groupBy("dataset").agg(F.count("*").alias("n"), F.avg("ap_norm").alias("ap_norm"), F.max("ap_norm").alias("best"))
    return out.where(F.col("n") >= least).select("dataset", "n", "ap_norm", (F.col("best") - F.col("ap_norm")).alias("regret"))


def separability(train: DataFrame, normals: DataFrame, anomalies: DataFrame, k: int = 10) -> DataFrame:
    """(ap_norm): how far the mean distance to the k nearest training rows, all standardised by them, sets anomalies apart."""
    part = lambda t, tag, y: t.select((F.col("id") * 3 + tag).alias("id"), F.lit(tag == 0).alias("train"), "v", F.lit(y).alias("y"))
    rows = part(train, 0, 0).union(part(normals, 1, 0)).union(part(anomalies, 2, 1))
    z = vectors_of(det.standardised(det.long_form(rows))).join(rows.drop("v"), "id")
    judged = det.knn_mean(z, k).join(rows.where("not train").select("id", "y"), "id").withColumn("score", F.round("score", 9))
    return average_precision(judged.withColumn("g", F.lit(0)), ["g"], "score", "y").select("ap", "base_rate", "ap_norm")


def ensemble(scores: DataFrame) -> DataFrame:
    """(id, mean_rank, max_rank, mean_z, max_z) over the detectors of (detector, id, score)."""
    scores = stored(scores, "scores")
    both = det.standard_scores(scores).select("detector", "id", "z", "n").join(det.mean_ranks(scores), ["detector", "id"])
    share = F.col("r") / F.col("n")
    return both.groupBy("id").agg(F.avg(share).alias("mean_rank"), F.max(share).alias("max_rank"), F.avg("z").alias("mean_z"), F.max("z").alias("max_z"))


def cluster_geometry_baseline(labelled: DataFrame, names: tuple[str, ...] = PANEL) -> DataFrame:
    """(detector, score): the mean composite of the clusters, the same for every detector; rank correlations note it as all tied."""
    one = det.cluster_composite(labelled).agg(F.avg("composite").alias("score"))
    return one.select(F.explode(F.array(*map(F.lit, names))).alias("detector"), "score")
