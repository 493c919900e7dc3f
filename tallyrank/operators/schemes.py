"""Weights for regimes of pseudo-tasks, and rankings voted by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ratio, spearman
from ..functions.ranks import avg_rank

REGIME = ["dataset", "regime"]


def per_dataset():
    return Window.partitionBy("dataset")


def regime_means(fact: DataFrame) -> DataFrame:
    """(dataset, regime, detector, auc, vote): vote is the ascending rank, larger is better."""
    per = fact.where("pseudo_auc is not null").groupBy(*REGIME, "detector").agg(F.avg("pseudo_auc").alias("auc"))
    return per.withColumn("vote", avg_rank("auc", *REGIME, descending=False))


def normalised(weights: DataFrame) -> DataFrame:
    """Weights of a dataset's regimes to sum 1; equal where they sum to nothing."""
    total = F.sum("w").over(per_dataset())
    return weights.withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(F.lit(1.0) / F.count("*").over(per_dataset())))


def uniform(means: DataFrame, fact: DataFrame) -> DataFrame:
    return means.select(*REGIME).distinct().withColumn("w", F.lit(1.0))


def discriminative(means: DataFrame, fact: DataFrame) -> DataFrame:
    """Sample variance of the detectors' AUC."""
    return means.groupBy(*REGIME).agg(F.coalesce(F.var_samp("auc"), F.lit(0.0)).alias("w"))


def stability(means: DataFrame, fact: DataFrame) -> DataFrame:
    """Inverse of the mean deviation of a detector's rank over the subsets."""
    ranks = fact.where("pseudo_auc is not null").withColumn("r", avg_rank("pseudo_auc", *REGIME, "subset"))
    per = ranks.groupBy(*REGIME, "detector").agg(F.stddev_samp("r").alias("s"))
    return per.groupBy(*REGIME).agg(F.coalesce(1 / (F.avg("s") + 1e-6), F.lit(0.0)).alias("w"))


def margin(means: DataFrame, fact: DataFrame) -> DataFrame:
    """Best AUC minus second best."""
    order = Window.partitionBy(*REGIME).orderBy(F.col("auc").desc(), "detector")
    top = means.withColumn("k", F.row_number().over(order))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("auc")))
    return top.groupBy(*REGIME).agg(F.coalesce(pick(1) - pick(2), F.lit(0.0)).alias("w"))


def regime_agreement(means: DataFrame) -> DataFrame:
    """(dataset, r1, r2, rho) for ordered pairs of regimes with at least three common detectors."""
    a = means.select("dataset", "detector", F.col("regime").alias("r1"), F.col("auc").alias("x"))
    b = means.select("dataset", "detector", F.col("regime").alias("r2"), F.col("auc").alias("y"))
    pairs = a.join(b, ["dataset", "detector"]).where("r1 <> r2")
    return spearman(pairs, ["dataset", "r1", "r2"], "x", "y").where("note = ''").select("dataset", "r1", "r2", "rho")


def agreement(means: DataFrame, fact: DataFrame) -> DataFrame:
    """Mean Spearman with the other regimes, floored at 0."""
    rho = regime_agreement(means).groupBy("dataset", F.col("r1").alias("regime")).agg(F.round(F.avg("rho"), 12).alias("rho"))
    return means.select(*REGIME).distinct().join(rho, REGIME, "left").select(*REGIME, F.greatest(F.coalesce("rho", F.lit(0.0)), F.lit(0.0)).alias("w"))


def softmax_variance(temperature: float):
    def scheme(means: DataFrame, fact: DataFrame) -> DataFrame:
        w = discriminative(means, fact)
        return w.select(*REGIME, F.exp((F.col("w") - F.max("w").over(per_dataset())) / temperature).alias("w"))

    return scheme


def product(one, two):
    def scheme(means: DataFrame, fact: DataFrame) -> DataFrame:
        b = two(means, fact).withColumnRenamed("w", "w2")
        return one(means, fact).join(b, REGIME).select(*REGIME, (F.col("w") * F.col("w2")).alias("w"))

    return scheme


def best_only(scheme):
    """All weight on the regime of the largest weight, ties by name."""

    def pick(means: DataFrame, fact: DataFrame) -> DataFrame:
        order = Window.partitionBy("dataset").orderBy(F.col("w").desc(), "regime")
        return scheme(means, fact).select(*REGIME, (F.row_number().over(order) == 1).cast("double").alias("w"))

    return pick


def one_regime(*names: str):
    def pick(means: DataFrame, fact: DataFrame) -> DataFrame:
        return means.select(*REGIME).distinct().withColumn("w", F.col("regime").isin(*names).cast("double"))

    return pick


SCHEMES = {
    "uniform": uniform,
    "discriminative": discriminative,
    "stability": stability,
    "margin": margin,
    "agreement": agreement,
    "softmax_var": softmax_variance(0.01),
    "disc_x_stab": product(discriminative, stability),
    "disc_agree": product(discriminative, agreement),
    "best_regime_var": best_only(discriminative),
    "best_regime_agr": best_only(agreement),
}


def voted(fact: DataFrame, scheme) -> DataFrame:
    """(dataset, detector, score): weighted sum of the regimes' votes."""
    means = regime_means(fact)
    w = normalised(scheme(means, fact))
    return means.join(w, REGIME).groupBy("dataset", "detector").agg(F.sum(F.col("w") * F.col("vote")).alias("score"))


def z_of(value: Column, window, ddof: int) -> Column:
    sd = (F.stddev_samp(value) if ddof else F.stddev_pop(value)).over(window)
    return (value - F.avg(value).over(window)) / F.when(sd > 0, sd).otherwise(1.0)


def zscore(fact: DataFrame, scheme=discriminative) -> DataFrame:
    """Weighted sum of the regimes' standardised AUC in place of votes."""
    means = regime_means(fact)
    z = means.withColumn("z", z_of(F.col("auc"), Window.partitionBy(*REGIME), 1))
    return z.join(normalised(scheme(means, fact)), REGIME).groupBy("dataset", "detector").agg(F.sum(F.col("w") * F.col("z")).alias("score"))


def top1_vote(fact: DataFrame) -> DataFrame:
    """A thousand for each regime won, plus the votes."""
    order = Window.partitionBy(*REGIME).orderBy(F.col("auc").desc(), "detector")
    won = regime_means(fact).withColumn("won", (F.row_number().over(order) == 1).cast("int"))
    return won.groupBy("dataset", "detector").agg((F.sum("won") * 1000 + F.sum("vote")).alias("score"))


def min_max(value: Column, window) -> Column:
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def debias_mix(fact: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha of the min-max vote and the rest of the min-max z-score of a detector over the datasets."""
    mean = fact.where("pseudo_auc is not null").groupBy("dataset", "detector").agg(F.avg("pseudo_auc").alias("auc"))
    mean = mean.withColumn("vote", avg_rank("auc", "dataset", descending=False)).withColumn("z", z_of(F.col("auc"), Window.partitionBy("detector"), 1))
    return mean.select("dataset", "detector", (alpha * min_max(F.col("vote"), per_dataset()) + (1 - alpha) * min_max(F.col("z"), per_dataset())).alias("score"))


def confidence(fact: DataFrame) -> DataFrame:
    """(dataset, top1_agree, rank_margin, mean_rho): share of regimes that agree on the winner, gap of the first two votes, mean agreement."""
    means = regime_means(fact)
    order = Window.partitionBy(*REGIME).orderBy(F.col("auc").desc(), "detector")
    wins = means.withColumn("k", F.row_number().over(order)).where("k = 1").groupBy("dataset", "detector").agg(F.count("*").alias("c"))
    agree = wins.groupBy("dataset").agg(ratio(F.max("c"), F.sum("c")).alias("top1_agree"))
    by_vote = Window.partitionBy("dataset").orderBy(F.col("score").desc(), "detector")
    votes = voted(fact, uniform).withColumn("k", F.row_number().over(by_vote))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("score")))
    gap = votes.groupBy("dataset").agg(ratio(pick(1) - pick(2), F.count("*") - 1).alias("rank_margin"))
    rho = regime_agreement(means).where("r1 < r2").groupBy("dataset").agg(F.avg("rho").alias("mean_rho"))
    return agree.join(gap, "dataset").join(rho, "dataset", "left")
