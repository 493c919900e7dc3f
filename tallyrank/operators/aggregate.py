"""Turning pseudo-task scores into one ranking of detectors per dataset, and comparing rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ratio
from ..functions.ranks import avg_rank, hash_numbered, row_order
from ..functions.scratch import stored

KEY = ["dataset", "detector"]


def ranked(df: DataFrame, name: str) -> DataFrame:
    return df.select(*KEY, F.lit(name).alias("aggregation"), "score", avg_rank("score", "dataset").alias("rank"))


def mean_scores(fact: DataFrame) -> DataFrame:
    return ranked(fact.groupBy(*KEY).agg(F.avg("pseudo_auc").alias("score")), "mean")


def borda(fact: DataFrame) -> DataFrame:
    """Mean rank over the pseudo-tasks (regime, subset) that scored the detector; score is its negative."""
    per = fact.where("pseudo_auc is not null").withColumn("r", avg_rank("pseudo_auc", "dataset", "regime", "subset"))
    return ranked(per.groupBy(*KEY).agg((-F.avg("r")).alias("score")), "borda")


def variance_weighted(fact: DataFrame) -> DataFrame:
    """Mean weighted by how far a pseudo-task tells the detectors apart; a plain mean where none does."""
    per_task = Window.partitionBy("dataset", "regime", "subset")
    per = fact.where("pseudo_auc is not null").withColumn("w", F.coalesce(F.var_samp("pseudo_auc").over(per_task), F.lit(0.0)))
    flat = F.sum("w").over(Window.partitionBy("dataset", "detector")) < 1e-12
    per = per.withColumn("w", F.when(flat, 1.0).otherwise(F.col("w")))
    return ranked(per.groupBy(*KEY).agg(ratio(F.sum(F.col("w") * F.col("pseudo_auc")), F.sum("w")).alias("score")), "varweight")


def with_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted score and true AUC side by side; truth is one row per dataset and detector."""
    return pred.join(truth, KEY)


def best_first(value: str, *more: str):
    """Rank 1 is the highest value; ties go by detector name."""
    return row_order(F.col(value).desc(), F.col("detector").asc(), groups=("dataset", *more))


def hits(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(dataset, top1_hit, top3_hit_ratio)."""
    both = with_truth(pred, truth).select("dataset", best_first("score").alias("p"), best_first("true_auc").alias("t"))
    return both.groupBy("dataset").agg(
        F.max(((F.col("p") == 1) & (F.col("t") == 1)).cast("int")).alias("top1_hit"),
        (F.count_if((F.col("p") <= 3) & (F.col("t") <= 3)) / F.lit(3.0)).alias("top3_hit_ratio"),
    )


def regret(pred: DataFrame, truth: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, groups, regret1, regret3, random_regret): best true AUC minus that of the pick, of the best of three, of a random pick."""
    both = with_truth(pred, truth).withColumn("p", best_first("score", *groups))
    best = F.max("true_auc")
    return both.groupBy("dataset", *groups).agg(
        (best - F.max(F.when(F.col("p") == 1, F.col("true_auc")))).alias("regret1"),
        (best - F.max(F.when(F.col("p") <= 3, F.col("true_auc")))).alias("regret3"),
        (best - F.avg("true_auc")).alias("random_regret"),
    )


def mean_and_spread(df: DataFrame, value: str, outer: list[str], seed: str) -> DataFrame:
    """Mean over datasets within a seed, then mean and both deviations over the seeds."""
    per = df.groupBy(*outer, seed).agg(F.avg(value).alias("m"))
    return per.groupBy(*outer).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std_ddof1"), F.stddev_pop("m").alias("std_ddof0"), F.count("*").alias("n_seeds"))


def drop_one(df: DataFrame, item: str = "detector") -> DataFrame:
    """The table once for each item with that item left out, and once whole (``dropped`` empty)."""
    names = df.select(F.col(item).alias("dropped")).distinct().union(df.sparkSession.createDataFrame([("",)], "dropped string"))
    return df.join(F.broadcast(names), F.col(item) != F.col("dropped"))  # one row an item: the panel's names


def scrambled(df: DataFrame, value: str, keys: list[str], seed: int) -> DataFrame:
    """The values dealt anew to the keys, by two hash orders: the negative control."""
    df = stored(df.select(*keys, value), "scrambled")
    a = hash_numbered(df.select(*keys), "__n", *keys)
    b = hash_numbered(df, "__n", F.lit(seed), *keys).select(value, "__n")
    return a.join(b, "__n").drop("__n")
