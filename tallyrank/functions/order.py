"""Places of rows within groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str = "pos", step: str = "numbered") -> DataFrame:
    """``df`` with ``name`` (long): the place, from 0, of each row in its group by ``order``; of ties any is first.

    The table is dealt into ranges of (group, order), so a large group spreads over many tasks.
    Two passes: rows get their place within their range, then each range's rows of a group are
    moved on by those of the ranges before it, a list of ranges only. Null groups are groups.
    """
    number, first, part = unused(df, "number", "first", "part")
    keys = unused(df, *(f"{c}_" for c in group))
    spread = df.repartitionByRange(*(F.col(f"`{c}`") if isinstance(c, str) else c for c in [*group, *order]))
    spread = spread.sortWithinPartitions(*(F.col(f"`{c}`") if isinstance(c, str) else c for c in [*group, *order]))
    # (number of the range, place in it) in one long, as Spark counts them
    spread = stored(spread.withColumn(number, F.monotonically_increasing_id()), step)
    range_of = F.shiftright(number, 33)
    ranges = spread.groupBy(*(F.col(f"`{c}`").alias(k) for c, k in zip(group, keys, strict=True)), range_of.alias(part)).agg(F.min(number).alias(first), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*keys, part, (F.col(first) - before).alias(first))
    same = range_of == F.col(part)
    for c, k in zip(group, keys, strict=True):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
    placed = spread.join(ranges.hint("shuffle_hash"), same)
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(number) - F.col(first)).alias(name))


def beside(df: DataFrame, table: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of columns of ``df`` with those of ``table``."""
    same = F.lit(True)
    for a, b in pairs:
        same = same & df[f"`{a}`"].eqNullSafe(table[f"`{b}`"])
    return same


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], part: str | None = None, own: bool = False) -> DataFrame:
    """``df`` with, per name in ``sums``, the sum of that column over the group's rows ahead in ``order`` (``own``: and the row itself).

    A running sum by two passes: within ranges of (group, order), then the totals of the ranges
    ahead, which are a list of ranges only; no task holds a group. ``part`` names a column that
    numbers ranges already; else the table is dealt into ranges and stored. The order must be total,
    or its ties alike in what is summed.
    """
    (where,) = unused(df, "range_no")
    if part is None:
        df_at = stored(df.repartitionByRange(*(F.col(f"`{c}`") for c in [*group, *order])).withColumn(where, F.spark_partition_id()), "ranges")
    else:
        df_at = df.withColumn(where, F.col(f"`{part}`"))
    keys = unused(df_at, *(f"{c}_" for c in group), f"{where}_")
    totals = unused(df_at, *(f"{n}_before" for n in sums))
    ahead = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    table = df_at.groupBy(*(F.col(f"`{c}`").alias(k) for c, k in zip([*group, where], keys, strict=True))).agg(*(F.sum(c).alias(t) for c, t in zip(sums.values(), totals, strict=True)))
    table = table.select(*keys, *(F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(t) for t in totals))
    within = Window.partitionBy(*(F.col(f"`{c}`") for c in group), where).orderBy(*(F.col(f"`{c}`") for c in order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = df_at.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()))
    out = out.join(table, beside(out, table, list(zip([*group, where], keys, strict=True))))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(n) + F.col(t)).alias(n) for n, t in zip(sums, totals, strict=True)))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """(groups, ``name``: array): exact quantiles with linear interpolation, nulls left out; a group of nulls only has none.

    The rows are numbered by ranges of their values and the few wanted places read, so no task
    holds the values of a group. Without groups: one row, null where there are no values.
    """
    rows = df.where(F.col(f"`{value}`").isNotNull()).select(*(F.col(f"`{c}`") for c in groups), F.col(f"`{value}`").cast("double").alias("v"))
    placed = numbered(rows, groups, ["v"], "at", "sorted-values")
    sizes = rows.groupBy(*(F.col(f"`{c}`").alias(f"{c}_") for c in groups)).agg((F.count("*") - 1).alias("last"))
    wants = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)))).alias("w")
    wants = sizes.select("*", wants)
    place = F.col("last") * F.col("w.share")
    low = F.floor(place)
    wants = wants.select(*(F.col(f"`{c}_`") for c in groups), F.col("w.i").alias("i"), (place - low).alias("rest"), F.explode(F.array_distinct(F.array(low, F.ceil(place)))).alias("want"), low.alias("low"))
    found = placed.join(wants, (placed["at"] == wants["want"]) & beside(placed, wants, [(c, f"{c}_") for c in groups]))
    share = F.when(F.col("want") == F.col("low"), 1 - F.col("rest")).otherwise(F.col("rest"))
    each = found.groupBy(*(F.col(f"`{c}`") for c in groups), "i").agg(F.sum(F.when(share > 0, share * F.col("v")).otherwise(0.0)).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    out = each.groupBy(*(F.col(f"`{c}`") for c in groups)).agg(ordered.alias(name))
    return out if groups else out.select(F.when(F.size(name) > 0, F.col(name)).alias(name))
