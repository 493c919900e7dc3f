"""Ranking metrics over long tables of (group, score, 0/1 label).

Scores are first reduced to counts per distinct score. What stands above a score is a running sum
by ranges of scores (``order.running``), so continuous scores of one group spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import beside, running, unused
from .ranks import avg_rank


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def score_counts(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Per group and distinct score: n and p (positives), with totals and counts above."""
    per = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*groups, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    (down,) = unused(per, "down")
    run = running(per.withColumn(down, -F.col(score)), groups, [down], {"tp0": F.col("p"), "fp0": F.col("n") - F.col("p")}).drop(down)
    keys = unused(run, *(f"{g}_" for g in groups))
    whole = run.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True))).agg(F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return run.join(whole, beside(run, whole, list(zip(groups, keys, strict=True)))).drop(*keys)


def roc_auc(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """(groups, auc): chance that a positive scores above a negative, ties half. Null with one class only."""
    c = score_counts(df, groups, score, label)
    neg = F.col("n") - F.col("p")
    wins = F.sum(F.col("p") * (F.col("neg") - F.col("fp0") - neg) + F.col("p") * neg / F.lit(2.0))
    out = c.groupBy(*groups).agg(wins.alias("w"), F.first("pos").alias("pos"), F.first("neg").alias("neg"))
    return out.select(*groups, ratio(F.col("w"), F.col("pos") * F.col("neg")).alias("auc"))


def average_precision(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """(groups, ap, base_rate, ap_norm): precision at each distinct threshold weighted by its recall step."""
    c = score_counts(df, groups, score, label)
    tp, fp = F.col("tp0") + F.col("p"), F.col("fp0") + F.col("n") - F.col("p")
    ap = F.sum(ratio(F.col("p"), F.col("pos")) * ratio(tp, tp + fp))
    out = c.groupBy(*groups).agg(ap.alias("ap"), F.first(ratio(F.col("pos"), F.col("pos") + F.col("neg"))).alias("base_rate"))
    return out.withColumn("ap_norm", ap_norm(F.col("ap"), F.col("base_rate")))


def ap_norm(ap: Column, base: Column) -> Column:
    return ratio(ap - base, 1 - base)


def partial_auc(df: DataFrame, groups: list[str], score: str, label: str, max_fpr: float = 0.1) -> DataFrame:
    """(groups, pauc): area to ``max_fpr``, standardised to 0.5 for chance and 1 for perfect."""
    c = score_counts(df, groups, score, label)
    f0, t0 = ratio(F.col("fp0"), F.col("neg")), ratio(F.col("tp0"), F.col("pos"))
    f1 = ratio(F.col("fp0") + F.col("n") - F.col("p"), F.col("neg"))
    t1 = ratio(F.col("tp0") + F.col("p"), F.col("pos"))
    c = c.select(*groups, f0.alias("f0"), t0.alias("t0"), f1.alias("f1"), t1.alias("t1")).where(F.col("f0") < max_fpr)
    end = F.least("f1", F.lit(max_fpr))
    t_end = F.col("t0") + F.when(F.col("f1") > F.col("f0"), (F.col("t1") - F.col("t0")) * (end - F.col("f0")) / (F.col("f1") - F.col("f0"))).otherwise(0.0)
    area = F.sum((end - F.col("f0")) * (F.col("t0") + t_end) / 2)
    low = max_fpr * max_fpr / 2
    return c.groupBy(*groups).agg((0.5 * (1 + (area - low) / (max_fpr - low))).alias("pauc"))


def recall_at_fpr(df: DataFrame, groups: list[str], score: str, label: str, fpr: float = 0.1) -> DataFrame:
    """(groups, recall): interpolated true positive rate where the false positive rate is ``fpr``."""
    c = score_counts(df, groups, score, label)
    f0, t0 = ratio(F.col("fp0"), F.col("neg")), ratio(F.col("tp0"), F.col("pos"))
    f1 = ratio(F.col("fp0") + F.col("n") - F.col("p"), F.col("neg"))
    t1 = ratio(F.col("tp0") + F.col("p"), F.col("pos"))
    c = c.select(*groups, f0.alias("f0"), t0.alias("t0"), f1.alias("f1"), t1.alias("t1")).where((F.col("f0") <= fpr) & (F.col("f1") > fpr))
    at = F.col("t0") + (F.col("t1") - F.col("t0")) * (F.lit(fpr) - F.col("f0")) / (F.col("f1") - F.col("f0"))
    return c.groupBy(*groups).agg(F.max(at).alias("recall"))


def anomaly_percentile(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """(groups, anom_pct): median over the positives of the share of rows that score strictly lower, in per cent."""
    c = score_counts(df, groups, score, label)
    below = F.col("pos") + F.col("neg") - F.col("tp0") - F.col("fp0") - F.col("n")
    c = c.where("p > 0").withColumn("pct", 100.0 * below / (F.col("pos") + F.col("neg")))
    return c.groupBy(*groups).agg(F.percentile("pct", F.lit(0.5), F.col("p")).alias("anom_pct"))


def spearman(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """(groups, n, note, rho): Pearson of mean ranks, taken anew over the rows where both are known."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.select(*groups, avg_rank(a, *groups).alias("ra"), avg_rank(b, *groups).alias("rb"))
    out = ranked.groupBy(*groups).agg(
        F.count("*").alias("n"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb"), F.covar_pop("ra", "rb").alias("cov")
    )
    note = F.when(F.col("n") < 3, "n<3").when(F.col("va") == 0, "true_all_tied").when(F.col("vb") == 0, "pred_all_tied").otherwise("")
    out = out.withColumn("note", note)
    return out.select(*groups, "n", "note", F.when(F.col("note") == "", ratio(F.col("cov"), F.sqrt(F.col("va") * F.col("vb")))).alias("rho"))


def kendall(df: DataFrame, groups: list[str], item: str, a: str, b: str) -> DataFrame:
    """(groups, tau): tau-b over pairs of items of a group. Groups are panels of detectors, so pairs stay few."""
    left = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, F.col(item).alias("i1"), F.col(a).alias("a1"), F.col(b).alias("b1"))
    right = left.select(*groups, F.col("i1").alias("i2"), F.col("a1").alias("a2"), F.col("b1").alias("b2"))
    s, t = F.signum(F.col("a1") - F.col("a2")), F.signum(F.col("b1") - F.col("b2"))
    pairs = left.join(right, groups).where("i1 < i2")
    out = pairs.groupBy(*groups).agg(F.sum(s * t).alias("c"), F.sum(F.abs(s)).alias("x"), F.sum(F.abs(t)).alias("y"))
    return out.select(*groups, ratio(F.col("c"), F.sqrt(F.col("x") * F.col("y"))).alias("tau"))
