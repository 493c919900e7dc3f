"""Rank expressions. Ties get their mean rank; results are always double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def avg_rank(value: str, *groups: str, descending: bool = True) -> Column:
    """Mean rank of ties within a group; with ``descending`` the highest value has rank 1."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    tied = F.count("*").over(Window.partitionBy(*groups, value))
    return F.rank().over(Window.partitionBy(*groups).orderBy(order)) + (tied - 1) / F.lit(2.0)


def pct_rank(value: str, *groups: str) -> Column:
    """Ascending mean rank over the group's size."""
    return avg_rank(value, *groups, descending=False) / F.count("*").over(Window.partitionBy(*groups))


def row_order(*order: Column, groups: tuple[str, ...] = ()) -> Column:
    """Row number as long under a total order given by the caller."""
    return F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")


def hash_order(*parts) -> Column:
    """Pseudo-random order: md5 of the parts joined by colons (integers and strings only)."""
    return F.md5(F.concat_ws(":", *(F.col(p) if isinstance(p, str) else p for p in parts)))


def hash_numbered(df: DataFrame, name: str, *parts) -> DataFrame:
    """Adds ``name``: the row's place, from 1, in ``hash_order`` of the whole table.

    Rows are counted by the first two digits of the hash, and numbered within those, so no task orders the whole table.
    """
    at = df.withColumn("__h", hash_order(*parts)).withColumn("__p", F.substring("__h", 1, 2))
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows at most
    sizes = at.groupBy("__p").agg(F.count("*").alias("__c")).select("__p", F.coalesce(before, F.lit(0)).alias("__b"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__h"))
    return at.withColumn("__k", place).join(F.broadcast(sizes), "__p").withColumn(name, F.col("__k") + F.col("__b")).drop("__h", "__p", "__k", "__b")


def hash_unit(*parts) -> Column:
    """Deterministic uniform number in [0, 1): the first 32 bits of ``hash_order``."""
    return F.conv(F.substring(hash_order(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
