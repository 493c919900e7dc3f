"""Facts that the registered queries share, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def grid(value):
    """Rounded to multiples of 2**-20: sums of such values are exact in any order."""
    return F.round(value * 1048576) / 1048576


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-task scores: nation as dataset, market segment as detector, three regimes of eight subsets."""
    c = table(spark, sf_dir, "customer")
    keys = [
        F.col("c_nationkey").alias("dataset"),
        F.col("c_mktsegment").alias("detector"),
        F.concat(F.lit("r"), (F.col("c_custkey") % 3).cast("string")).alias("regime"),
        (F.col("c_custkey") % 8).alias("subset"),
    ]
    return c.groupBy(*keys).agg(grid(F.avg((F.col("c_acctbal") + 1000) / 11000)).alias("pseudo_auc"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    both = o.join(c, o["o_custkey"] == c["c_custkey"])
    return both.groupBy(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("detector")).agg(grid(F.avg("o_totalprice") / 500000).alias("true_auc"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: order priority as group, rounded price as score, status F as anomaly."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("g"), F.round(F.col("o_totalprice") / 1000, 0).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )


FACT = """fact AS (
  SELECT c_nationkey AS dataset, c_mktsegment AS detector, 'r' || (c_custkey % 3) AS regime, c_custkey % 8 AS subset,
         round(avg((c_acctbal + 1000) / 11000) * 1048576) / 1048576 AS pseudo_auc
  FROM customer GROUP BY ALL)"""
TRUTH = """truth AS (
  SELECT c_nationkey AS dataset, c_mktsegment AS detector, round(avg(o_totalprice) / 500000 * 1048576) / 1048576 AS true_auc
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
SCORED = "scored AS (SELECT o_orderkey AS id, o_orderpriority AS g, round(o_totalprice / 1000, 0) AS score, (o_orderstatus = 'F')::INT AS y FROM orders)"
MEANS = """means AS (
  SELECT *, rank() OVER (PARTITION BY dataset, regime ORDER BY auc) + (count(*) OVER (PARTITION BY dataset, regime, auc) - 1) / 2 AS vote
  FROM (SELECT dataset, regime, detector, avg(pseudo_auc) AS auc FROM fact GROUP BY ALL))"""


def r(expr: str, name: str | None = None) -> str:
    """A rounded output column of SQL."""
    return f"round({expr}, 9) + 0.0::DOUBLE AS {name or expr}"
