"""Secret scanning with multipart credential linking (DataFrame functions only).

Base kinds are reported wherever they occur: ``assign`` (a keyword given a value),
``access`` (access key identifiers) and ``hex`` (long hexadecimal runs). Two weak kinds,
``secret`` (long mixed tokens) and ``endpoint`` (URLs), mean nothing alone. An interval
join, bucketed by scope so that it is an equi-join, links them to access identifiers or
assignments that start within ``scope`` code points in the same document; only linked
weak spans are reported.

Defined results: a null text counts as empty; rows are judged one by one, repeated rows
give repeated results and null ids are kept; no spans gives an empty string, whose
SHA-256 is that of no bytes; an empty table gives an empty result; other columns of the
input are ignored, whatever their names; very long texts are searched whole, in time linear
in their length and almost linear in their hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KINDS, SPANS, row_key, span_list, spans_between, spans_text, stored

#: The patterns of the base kinds (assign is filtered by its value below).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak kinds.
SECRET = r"[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"
#: Greatest distance in code points between the starts of parts of one credential.
SCOPE = 300


def _guarded(text: Column, needle: Column, spans: Column) -> Column:
    return F.when(needle, spans).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(spans_between(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    return {
        "assign": _guarded(text, F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), assign),
        "access": _guarded(text, F.contains(text, F.lit("AKIA")), spans_between(text, ACCESS)),
        "hex": spans_between(text, HEX),
    }


def weak_spans(text: Column) -> dict[str, Column]:
    mixed = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
    return {
        "secret": F.filter(spans_between(text, SECRET), mixed),
        "endpoint": _guarded(text, F.contains(text, F.lit("://")), spans_between(text, ENDPOINT)),
    }


#: Which strong kinds complete a weak one.
COMPLEMENTS = {"secret": ["access"], "endpoint": ["access", "assign"]}


def find_spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, ``base`` (spans sorted by start, then kind) and ``linked``
    (weak spans with a complementary part in scope)."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    rows = df.select(F.col(key).alias("__id"), F.col(text).alias("__t"))
    spans = base_spans(t)
    # weak kinds count only beside a strong one, so other documents aren't searched for them
    strong = rows.select(
        "__id",
        "__t",
        F.sort_array(F.concat(*(span_list(k, i, s) for i, (k, s) in enumerate(spans.items())))).alias("base"),
    )
    weak = F.concat(*(span_list(k, len(spans) + i, s) for i, (k, s) in enumerate(weak_spans(t).items())))
    near = F.exists(F.col("base"), lambda s: s["kind"].isin("access", "assign"))
    found = strong.select(
        "__id",
        row_key(F.col("__id"), F.col("__t")).alias("__row"),
        "base",
        F.when(near, weak).otherwise(F.array().cast(KINDS)).alias("weak"),
    )
    found = stored(found, "secret-spans")
    linked = link(found.where(F.size("weak") > 0).select("__row", "base", "weak").dropDuplicates(["__row"]))
    return found.join(linked, "__row", "left").select(
        F.col("__id").alias(key), "base", F.coalesce(F.col("linked"), F.array().cast(KINDS)).alias("linked")
    )


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of weak and strong parts within a row's text: (__row, linked)."""
    weak = found.select("__row", F.explode("weak").alias("w")).withColumn("bucket", F.floor(F.col("w.start") / scope))
    strong = found.select("__row", F.explode("base").alias("s")).where(F.col("s.kind") != "hex")
    # a part within ``scope`` starts in the same bucket or in a neighbouring one
    strong = strong.select(
        "__row",
        "s",
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("s.start") / scope) + d)).alias("bucket"),
    )
    fits = F.lit(False)
    for kind, partners in COMPLEMENTS.items():
        fits = fits | ((F.col("w.kind") == kind) & F.col("s.kind").isin(*partners))
    same = (weak["__row"] == strong["__row"]) & (weak["bucket"] == strong["bucket"])
    pairs = weak.join(strong, same & fits & (F.abs(F.col("w.start") - F.col("s.start")) <= scope), "left_semi")
    return pairs.groupBy("__row").agg(F.sort_array(F.collect_list("w")).alias("linked"))


def report(df: DataFrame) -> DataFrame:
    found = find_spans(df)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.sort_array(F.concat("base", "linked"))).alias("spans"),
    )
