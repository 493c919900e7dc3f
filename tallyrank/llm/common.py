"""Helpers shared by the corpus operators: expressions, scratch tables, table access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch, stored  # noqa: F401

#: ASCII white space that separates words, as a Java regular expression.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for a row and hand it to ``body``, so lambdas in it don't recompute it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


SPANS = "array<struct<start:int,end:int,value:string>>"

def shipped(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver (or of a store that Spark reads) to the executors; ``received`` finds it there."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def received(name: str) -> str:
    return SparkFiles.get(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: Column) -> Column:
    """Identifies a row by its values, nulls included; repeated rows share a key."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("~")) for c in cols)), 256)


def span_list(kind: str, rank: int, spans: Column) -> Column:
    """Spans with the name and rank of their kind, in the order that sorting by start then rank gives."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


KINDS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Lengths that are summed one by one; longer lists are summed in blocks of so many first.
_BLOCK = 64


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def sums_before(values: Column) -> Column:
    """For each number of a list the sum of those before it.

    In blocks, as an array that grows by appending is copied each time: n * (_BLOCK + n / _BLOCK**2) steps.
    """

    def placed(values):
        whole = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(values, b * _BLOCK + 1, _BLOCK)))

        def by_block(whole):
            def within(before):
                block = lambda i: (i / _BLOCK).cast("int")
                one = lambda i: F.get(before, block(i)) + _total(F.slice(values, block(i) * _BLOCK + 1, F.pmod(i, F.lit(_BLOCK))))
                return F.transform(values, lambda _, i: one(i))

            return let(F.transform(whole, lambda _, b: _total(F.slice(whole, 1, b))), within)

        return let(whole, by_block)

    return F.when(F.size(values) > 0, let(values, placed)).otherwise(F.array().cast("array<int>"))


def spans_between(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as structs (start, end, value).

    Offsets are code points, end exclusive. Built from the matches and the pieces
    between them, as Spark has no function that returns all positions.
    """

    def placed(found):
        def with_gaps(gaps):
            size = lambda g, h: F.length(g) + F.length(h)
            before = sums_before(F.zip_with(F.slice(gaps, 1, F.size(found)), found, size))

            def build(before):
                def one(hit, i):
                    start = F.get(before, i) + F.length(F.get(gaps, i))
                    return F.named_struct(F.lit("start"), start, F.lit("end"), start + F.length(hit), F.lit("value"), hit)

                return F.transform(found, one)

            return let(before, build)

        return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(let(F.split(text, pattern), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, starts, sizes) of sorted input, cut between batches at the ends of runs of equal keys only."""
    held = None
    for batch in batches:
        rows = batch if held is None or held.empty else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(rows) - int(last.sum())
        held = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield _runs(rows.iloc[:cut].reset_index(drop=True), keys)
    if held is not None and not held.empty:
        yield _runs(held, keys)


def _runs(rows: pd.DataFrame, keys: list[str]):
    changed = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
    starts = np.flatnonzero(changed)
    return rows, starts, np.diff(np.concatenate([starts, [len(rows)]]))
