"""Which filters of a cascade do the work: every order of the filters, from one CUBE over their failure flags.

1. Rows are reduced to cells: counts per part and combination of failure flags (and of their
   labels). After that no step depends on the number of rows.
2. CUBE over the flags and the part gives each subset of flags a grouping set. Its row in which
   all selected flags are false counts the subset's survivors; the grouping sets without the part
   give the same for the whole table. Subsets that nothing survives have no such row and count 0.
3. A step of an order removes what survives the filters ahead of it but not the filter itself: the
   difference of two subsets' survivors. So the survivors are joined with themselves in pairs
   (subset, subset and one filter more), n * 2^(n-1) a part, and each step of each order takes its
   pair. A filter's failures are the pair of the empty subset, its unique failures that of all
   other filters, and its total over all orders weighs the pairs by the number of orders that
   have them.

``audit`` takes any boolean columns; ``flagged`` makes the five of the corpus audit.

Defined results: a null flag is not a failure; a null text is empty (so empty and null texts are
identical); a null part is the empty string; a null doc_id is neither smaller nor larger than
another, so its row never fails as a repeat and makes none fail; repeated rows count each, and as
their doc_ids are equal none is the smaller; a document has a label if any of its label rows has
it; null labels count as 0; an empty table gives no rows; other columns are ignored, whatever
their names; a very long text is read whole. Texts are identical where their SHA-256 is.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words_of

COUNTS = ["n", "good", "toxic"]


def text_flags(text: Column) -> list[Column]:
    """Failure flags A to D of a text: short, repetitive, upper-case, symbols."""
    words = lambda w: F.struct((F.size(w) < 200).alias("A"), (100 * F.size(F.array_distinct(w)) < 50 * F.size(w)).alias("B"))
    both = let(words_of(text), words)
    capitals = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text)
    return [both["A"].alias("A"), both["B"].alias("B"), capitals.alias("C"), text.rlike("[#$%&*|]").alias("D")]


def flagged(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) per document; E: a row of smaller ``key`` has the same text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = documents.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("t"))
    # texts are read once; from here a document is its flags and a digest
    rows = stored(docs.select("id", "part", *text_flags(F.col("t")), F.unhex(F.sha2("t", 256)).alias("digest")), "flags")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    marks = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*marks)
    out = rows.join(first.hint("shuffle_hash"), "digest", "left").join(known.hint("shuffle_hash"), "id", "left")
    return out.select("part", *"ABCD", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def survivors(df: DataFrame, flags: list[str], part: str = "part") -> DataFrame:
    """(part, subset, n, good, toxic): what passes all flags of each subset (bits in the order of ``flags``); part null: the whole table.

    ``df`` has the boolean ``flags``, ``part`` and 0/1 columns good and toxic. Subsets without survivors are absent.
    """
    name = {c: f"f{i}" for i, c in enumerate(flags)}
    cells = df.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *(F.coalesce(F.col(c), F.lit(False)).alias(x) for c, x in name.items()), "good", "toxic")
    cells = cells.groupBy("part", *name.values()).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cube = cells.cube("part", *name.values()).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS), *(F.grouping(x).alias(f"g{x}") for x in name.values()))
    passed = [(F.col(f"g{x}") == 1) | ~F.col(x) for x in name.values()]
    subset = sum((1 << i) * (1 - F.col(f"g{x}").cast("int")) for i, x in enumerate(name.values()))
    for p in passed:
        cube = cube.where(p)
    return cube.select("part", subset.cast("int").alias("subset"), *COUNTS)


def pairs_of(found: DataFrame, n: int) -> DataFrame:
    """(part, filter, before, kept, removed, good_lost, toxic_lost): each subset of ``n`` filters beside the subset with one more."""
    everything = F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))).alias("subset")
    whole = found.select("part").distinct().select("part", everything).join(found, ["part", "subset"], "left")
    whole = whole.select("part", "subset", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))
    more = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.transform(F.array(*(F.lit(1 << k) for k in range(n))), lambda b: F.col("subset").bitwiseAND(b)), i) == 0)
    ahead = whole.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}0") for c in COUNTS), F.explode(more).alias("filter"))
    ahead = ahead.withColumn("subset", F.col("before") + F.get(F.array(*(F.lit(1 << k) for k in range(n))), F.col("filter")))
    both = ahead.join(whole, ["part", "subset"])
    return both.select("part", "filter", "before", F.col("n").alias("kept"), (F.col("n0") - F.col("n")).alias("removed"), (F.col("good0") - F.col("good")).alias("good_lost"), (F.col("toxic0") - F.col("toxic")).alias("toxic_lost"))


def audit(df: DataFrame, flags: list[str], part: str = "part") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of ``flags``.

    Orders are joined names; there are n! of them, so at most seven flags.
    """
    n = len(flags)
    if not 1 <= n <= 7:
        raise ValueError("one to seven flags")
    pairs = stored(pairs_of(survivors(df, flags, part).where("part is not null"), n), "subset-pairs")
    size = F.bit_count("before")
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size + 1)
    rest = 2**n - 1 - F.element_at(F.array(*(F.lit(1 << k) for k in range(n))), F.col("filter") + 1)
    of = pairs.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("before") == rest, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).cast("long").alias("shapley"),
    )
    steps = [("".join(flags[i] for i in o), k + 1, o[k], sum(1 << i for i in o[:k])) for o in permutations(range(n)) for k in range(n)]
    steps = df.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    # n! * n rows of constants, whatever the data
    out = pairs.join(of, ["part", "filter"]).join(F.broadcast(steps), ["filter", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(flagged(documents, labels), list("ABCDE"))
