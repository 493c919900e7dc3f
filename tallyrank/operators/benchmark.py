"""Building a benchmark: duplicates, fingerprints, hardness, inclusion, selectors and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.metrics import ratio
from ..functions.order import quantiles
from ..functions.ranks import row_order
from ..functions.scratch import stored
from . import detectors as det
from . import near


def drop_conflicts(df: DataFrame, features: list[str], key: str, label: str) -> DataFrame:
    """The first of identical rows; groups whose labels differ go whole. Aggregates first, so a hot row is one row per task."""
    g = df.groupBy(*features).agg(F.min(key).alias(key), F.min(label).alias(label), F.max(label).alias("__m"), F.count("*").alias("copies"))
    return g.where(F.col(label) == F.col("__m")).drop("__m")


def best_per(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("__k", row_order(*order, groups=(group,))).where("__k = 1").drop("__k")


def plain_name(name: Column) -> Column:
    """Without extension, leading number, underscores and dashes; lower case."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"^[0-9]+_", "")
    return F.lower(F.regexp_replace(bare, "[_-]", ""))


def fingerprint(points: DataFrame, group: str) -> DataFrame:
    """(group, fp): dims and hashes of the sorted means and deviations, as integers of thousandths."""
    per = points.groupBy(group, "dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    whole = lambda c: F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.round(F.col(c) * 1000).cast("long"))), lambda v: v.cast("string")), ","))
    return per.groupBy(group).agg(F.concat_ws("|", F.count("*").cast("string"), whole("mu"), whole("sd")).alias("fp"))


def same_across(df: DataFrame, name: str, fp: str) -> DataFrame:
    """Adds ``dedup_group``: rows of one plain name are one group if all have the same fingerprint, else each its own."""
    w = Window.partitionBy(name)
    one = (F.count(fp).over(w) == F.count("*").over(w)) & (F.min(fp).over(w) == F.max(fp).over(w))
    return df.withColumn("dedup_group", F.when(one, F.col(name)).otherwise(F.concat_ws(":", F.col(name), F.col("corpus"))))


def double_hard(df: DataFrame, groups: list[str], score: str, label: str, percentiles: list[float]) -> DataFrame:
    """(groups, percentile, n_hard): anomalies whose score stays within that percentile of the normals."""
    cut = quantiles(df.where(F.col(label) == 0), groups, score, [p / 100 for p in percentiles])
    cut = cut.select(*groups, F.explode(F.arrays_zip(F.array(*map(F.lit, percentiles)).alias("percentile"), F.col("q").alias("cut"))).alias("z")).select(*groups, "z.percentile", "z.cut")
    return df.where(F.col(label) == 1).join(cut, groups).groupBy(*groups, "percentile").agg(F.count_if(F.col(score) <= F.col("cut")).alias("n_hard"))


def two_stage(a: DataFrame, b: DataFrame, normals: DataFrame, share: float = 0.95) -> DataFrame:
    """(id, caught): a row is caught if either score passes that percentile of the held-out normals'.

    ``normals`` (id): rows that neither score was fitted on, else the promise of 1 - share false alarms doesn't hold.
    """
    def over(s, name):
        cut = quantiles(s.join(normals, "id", "left_semi"), [], "score", [share]).select(F.get("q", F.lit(0)).alias("c"))
        return s.join(F.broadcast(cut)).select("id", (F.col("score") > F.col("c")).cast("int").alias(name))  # one row

    return over(a, "a").join(over(b, "b"), "id").select("id", F.greatest("a", "b").alias("caught"))


def two_stage_hardening(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """(id, caught) by the severity of the rows as they are, and of their whitened components of 95 % of the variance.

    ``rows``: (id, train, normal, v); thresholds come from the normals that aren't training rows.
    """
    white = det.pca_embed(rows, 1 << 30, 0.95, True).join(rows.select("id", "train"), "id").withColumnRenamed("z", "v")
    plain, latent = (stored(det.severity(det.long_form(t)), "severity") for t in (rows, white))
    return two_stage(plain, latent, rows.where("normal and not train").select("id"), share)


def both_hard(rows: DataFrame, percentiles: list[float]) -> DataFrame:
    """(percentile, n_anomalies, n_hard, n_hard_maxz): anomalies that stay within that percentile of all normals in max-z and in the linear
    residual too (max-z alone where there is no residual). ``rows``: (id, train, v, y) with ``train`` true for the normals."""
    z = det.max_z(det.long_form(rows)).select("id", F.round("score", 9).alias("z"))
    own = stored(z.join(det.linear_residual(rows).select("id", F.round("score", 9).alias("l")), "id").join(rows.select("id", "y"), "id"), "hardness")
    of = lambda c: quantiles(own.where("y = 0"), [], c, [p / 100 for p in percentiles], f"q{c}")
    cut = of("z").join(F.broadcast(of("l")))  # one row each
    cut = cut.select(F.explode(F.arrays_zip(F.array(*map(F.lit, percentiles)).alias("percentile"), "qz", "ql")).alias("c")).select("c.*")
    easy = F.col("z") > F.col("qz")
    return own.where("y = 1").join(F.broadcast(cut)).groupBy("percentile").agg(  # a row a percentile
        F.count("*").alias("n_anomalies"), F.count_if(~easy & F.coalesce(F.col("l") <= F.col("ql"), F.lit(True))).alias("n_hard"), F.count_if(~easy).alias("n_hard_maxz")
    )


def staged(candidates: DataFrame, trivial: float = 0.9, normals: int = 800, hard: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the candidates left, (stage, n)): few enough trivial anomalies, normals enough, effective hard anomalies enough, then the largest of equal fingerprints.

    ``candidates``: (dataset, frac_triv, n_norm, n_eff, fp).
    """
    one = candidates.where(F.col("frac_triv") < trivial)
    two = one.where(F.col("n_norm") >= normals)
    three = two.where(F.col("n_eff") >= hard)
    four = best_per(three, "fp", F.col("n_eff").desc(), F.col("dataset"))
    count = lambda t, n: t.agg(F.lit(n).alias("stage"), F.count("*").alias("n"))
    stages = count(candidates, "0 candidates")
    for name, t in (("1 not trivial", one), ("2 normals", two), ("3 hard anomalies", three), ("4 fingerprints", four)):
        stages = stages.union(count(t, name))
    return four, stages


def audit(included: DataFrame, family: Column) -> DataFrame:
    """(check, holds): whether a benchmark's included datasets are valid, diverse and fair.

    ``included``: (dataset, base_rate, spread, zone, best, gt_best).
    """
    i = included.withColumn("family", family)
    share = lambda c: i.groupBy(c).agg(F.count("*").alias("n")).select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("s"))  # noqa: E731  a row a winner
    one = i.agg(F.max("base_rate").alias("rate"), F.min("spread").alias("spread"), F.min((F.col("zone") == "live").cast("int")).alias("live"), F.min("best").alias("best"), F.count_distinct("gt_best").alias("winners"))
    one = one.join(F.broadcast(share("gt_best").agg(F.max("s").alias("top")))).join(F.broadcast(share("family").agg(F.max("s").alias("largest"), F.count_if(F.col("s") > 0.05).alias("active"))))  # one row each
    checks = {
        "base_rate_within_cap": F.col("rate") <= 0.2501, "spread_everywhere": F.col("spread") >= 0.1, "all_live": F.col("live") == 1, "best_above_base_rate": F.col("best") > 0,
        "no_winner_over_40_percent": F.col("top") <= 0.4, "twelve_winners": F.col("winners") >= 12, "no_family_over_75_percent": F.col("largest") <= 0.75, "two_families_win": F.col("active") >= 2,
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).cast("int").alias("holds")) for n, c in checks.items()))).alias("z")).select("z.*")


def refiltered(included: DataFrame, rule: DataFrame, picks: DataFrame, cut: float = 0.85) -> DataFrame:
    """(selector, before, after, n_before, n_after): mean regret over the included datasets, and over those whose rule AUC isn't above ``cut`` (none known: kept)."""
    kept = included.select("dataset").join(rule, "dataset", "left").withColumn("keep", ~F.coalesce(F.col("rule_auc") > cut, F.lit(False)))
    both = picks.join(kept, "dataset")
    after = F.when(F.col("keep"), F.col("regret"))
    return both.groupBy("selector").agg(F.avg("regret").alias("before"), F.avg(after).alias("after"), F.count("*").alias("n_before"), F.count(after).alias("n_after"))


def manifest(df: DataFrame) -> DataFrame:
    """Per dataset best, mean, worst and spread of ap_norm, ranking, zone and inclusion.

    ``df``: (dataset, variant, ap_norm, base_rate, rule_auc). A null rule AUC excludes nothing.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("ap_norm")).alias("m"), "variant")))["variant"]
    m = df.groupBy("dataset").agg(
        F.count("*").alias("n_variants"), F.max("base_rate").alias("base_rate"), F.max("ap_norm").alias("best"), F.avg("ap_norm").alias("mean"), F.min("ap_norm").alias("worst"),
        F.max("rule_auc").alias("rule_auc"), order.alias("o"),
    )
    m = m.withColumn("spread", F.col("best") - F.col("mean")).withColumn("gt_best", F.get("o", F.lit(0))).withColumn("gt_ranking", F.array_join("o", "|")).drop("o")
    m = m.withColumn("zone", F.when(F.col("best") < 0.1, "floor").when(F.col("spread") < 0.1, "low_spread").otherwise("live"))
    rule = F.coalesce(F.col("rule_auc") > 0.85, F.lit(False))
    return m.withColumn("include", (F.col("zone") == "live") & (F.col("base_rate") <= 0.25) & ~rule)


def selectors(df: DataFrame) -> DataFrame:
    """(selector, dataset, regret, rank_pos): picks by truth, its opposite, the variant best on average and label-free criteria.

    ``df``: (dataset, variant, truth, em, mv, consensus) and, if present, further criteria (centrality,
    hits, separability) and a ``modality``, within which the average is then taken; mv is best where
    smallest. Variants named like isolation forests give ``iforest_random``, their mean.
    """
    of = ["variant", *(c for c in ("modality",) if c in df.columns)]
    df = df.join(df.groupBy(*of).agg(F.avg("truth").alias("g")), of)
    by = {"oracle": F.col("truth"), "anti_oracle": -F.col("truth"), "global_fixed": F.col("g"), "em": F.col("em"), "mv": -F.col("mv"), "consensus": F.col("consensus")}
    by |= {c: F.col(c) for c in ("centrality", "hits", "separability") if c in df.columns}
    w = Window.partitionBy("dataset")
    placed = df.select(
        "dataset", "truth", F.col("variant").rlike("^(IForest|IF_)").alias("forest"), F.max("truth").over(w).alias("best"), F.count("*").over(w).alias("n"), (row_order(F.col("truth").desc(), F.col("variant"), groups=("dataset",)) - 1).alias("pos"),
        *(row_order(v.desc(), F.col("variant"), groups=("dataset",)).alias(f"k_{s}") for s, v in by.items()),
    )
    pick = F.explode(F.array(*(F.struct(F.lit(s).alias("selector"), F.col(f"k_{s}").alias("k")) for s in by)))
    picks = placed.select("dataset", "truth", "best", "n", "pos", pick.alias("p")).where("p.k = 1")
    picks = picks.select("p.selector", "dataset", (F.col("best") - F.col("truth")).alias("regret"), ratio(F.col("pos"), F.col("n") - 1).alias("rank_pos"))
    chance = df.groupBy("dataset").agg((F.max("truth") - F.avg("truth")).alias("regret")).select(F.lit("random").alias("selector"), "dataset", "regret", F.lit(0.5).alias("rank_pos"))
    forest = placed.where("forest").groupBy("dataset").agg((F.max("best") - F.avg("truth")).alias("regret"), F.avg(ratio(F.col("pos"), F.col("n") - 1)).alias("rank_pos"))
    return picks.union(chance).union(forest.select(F.lit("iforest_random").alias("selector"), "dataset", "regret", "rank_pos"))


def invariants(picks: DataFrame) -> DataFrame:
    """(check, holds): the oracle has no regret, nothing is worse than its opposite, a random pick lies in the middle, the global choice beats it."""
    mean = picks.groupBy("selector").agg(F.avg("regret").alias("m"))
    value = lambda s: F.max(F.when(F.col("selector") == s, F.col("m")))
    one = mean.agg(value("oracle").alias("o"), value("anti_oracle").alias("a"), F.max("m").alias("worst"), value("global_fixed").alias("g"), value("random").alias("r"))
    checks = {"oracle_zero": F.col("o") == 0, "anti_worst": F.col("a") >= F.col("worst"), "global_not_above_random": F.col("g") <= F.col("r")}
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c.cast("int").alias("holds")) for n, c in checks.items()))).alias("z")).select("z.*")


def leaderboard(picks: DataFrame, family: DataFrame) -> DataFrame:
    """(selector, micro, macro): mean regret over datasets, and mean of the families' means."""
    per = picks.join(family, "dataset").groupBy("selector", "family").agg(F.avg("regret").alias("m"), F.sum("regret").alias("s"), F.count("*").alias("n"))
    return per.groupBy("selector").agg((F.sum("s") / F.sum("n")).alias("micro"), F.avg("m").alias("macro"))


def leaderboard_tests(picks: DataFrame, against: tuple[str, ...] = ("em", "mv")) -> DataFrame:
    """(selector, against, n, z, p, p_exact): signed-rank tests of a selector's regrets against those of the criteria, dataset by dataset.

    p is the normal one with tie correction, p_exact that of all choices of signs (up to ``stats.EXACT`` differences); null without differences.
    """
    other = picks.where(F.col("selector").isin(*against)).select(F.col("selector").alias("against"), "dataset", F.col("regret").alias("r2"))
    both = picks.join(other, "dataset").where("selector <> against").withColumn("x", F.round(F.col("r2") - F.col("regret"), 12))
    pairs = both.select("selector", "against").distinct()
    tests = stats.with_p(stats.wilcoxon(both, ["selector", "against"], "x"))
    exact = stats.wilcoxon_exact(both, ["selector", "against"], "x").drop("n")
    tests = pairs.join(tests, ["selector", "against"], "left").join(exact, ["selector", "against"], "left")
    return tests.select("selector", "against", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "z", "p", "p_exact")


def routed(df: DataFrame, margin: float = -0.14) -> DataFrame:
    """(dataset, variant): the first criterion's pick unless its best value falls short of the second's by the margin.

    ``df``: (dataset, variant, a1, a4).
    """
    w = Window.partitionBy("dataset")
    k = lambda c: row_order(F.col(c).desc(), F.col("variant"), groups=("dataset",))
    p = df.select("dataset", "variant", k("a1").alias("k1"), k("a4").alias("k4"), (F.max("a1").over(w) - F.max("a4").over(w) > margin).alias("first"))
    return p.where(F.when(F.col("first"), F.col("k1") == 1).otherwise(F.col("k4") == 1)).select("dataset", "variant")


def family_hybrid(df: DataFrame, family: Column) -> DataFrame:
    """(dataset, variant): criterion em chooses the family, criterion synth the variant within it."""
    d = df.withColumn("family", family)
    top = best_per(d, "dataset", F.col("em").desc(), F.col("variant")).select("dataset", "family")
    return best_per(d.join(top, ["dataset", "family"], "left_semi"), "dataset", F.col("synth").desc(), F.col("variant")).select("dataset", "variant")


def greedy_cover(df: DataFrame, radius: float) -> DataFrame:
    """(dataset, n_eff): rows that a pass in order of id keeps, each farther than ``radius`` from all kept before.

    That is the first independent set in that order of the graph of rows within the radius. It is found in
    rounds: a row all of whose earlier neighbours are out is in, and its neighbours are out. A
    round decides at least each data set's first open row and mostly a share of all, and no task
    holds a data set. Neighbours come from the radius search of ``near``.
    """
    rows = df.select(F.col("dataset").alias("task"), F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    # of rows of one vector the first alone may be kept, and what covers it covers them, so they stand for each other
    rows = stored(rows.groupBy("task", "v").agg(F.min("id").alias("id")).select("task", "id", "v"), "cover-rows")
    edges = stored(near.within(rows, radius).where("other < id").select("task", "id", "other"), "cover-edges")
    # rows without an earlier neighbour are in whatever follows
    state = stored(rows.select("task", "id").join(edges.select("task", "id").distinct().withColumn("open", F.lit(True)), ["task", "id"], "left").select("task", "id", F.when(F.col("open"), 0).otherwise(1).alias("state")), "cover")
    while not state.where("state = 0").isEmpty():
        earlier = edges.join(state.where("state = 0").select("task", "id"), ["task", "id"], "left_semi").join(state.select("task", F.col("id").alias("other"), F.col("state").alias("s")), ["task", "other"])
        said = earlier.groupBy("task", "id").agg(F.max((F.col("s") == 1).cast("int")).alias("covered"), F.max((F.col("s") == 0).cast("int")).alias("waits"))
        state = stored(state.join(said, ["task", "id"], "left").select("task", "id", F.when(F.col("state") != 0, F.col("state")).when(F.col("covered") == 1, -1).when(F.col("waits") == 1, 0).otherwise(1).alias("state")), "cover")
    return state.groupBy(F.col("task").alias("dataset")).agg(F.count_if(F.col("state") == 1).alias("n_eff"))


def effective_count(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``greedy_cover`` of standardised rows at the training rows' own scale: the median distance to their nearest neighbour.

    ``train``: (id, v), ``rows``: (dataset, id, v).
    """
    both = train.select((F.col("id") * 2).alias("id"), F.lit(True).alias("train"), "v").union(rows.select((F.col("id") * 2 + 1).alias("id"), F.lit(False).alias("train"), "v"))
    z = det.standardised(det.long_form(both)).groupBy("id", "train").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))
    z = stored(z, "standardised")
    radius = quantiles(det.nearest(z.where("train"), 1), [], "distance", [0.5]).first()["q"][0] + 1e-9
    own = z.where("not train").select(F.floor((F.col("id") - 1) / 2).cast("long").alias("id"), "v")
    return greedy_cover(own.join(rows.select("dataset", "id"), "id"), radius)


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the work list without a finished row: what a resumed run has left."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
