"""Line dedup by content-defined chunks of lines and by windows of over 50 words (DataFrame functions only).

A text's lines are hashed; a rolling hash over the last ``WINDOW`` line hashes ends a
chunk where it falls on a multiple of ``DIVISOR``, so boundaries follow the content and
a passage moved up or down is cut the same way from its second line on. Chunks of two or
more lines are spans that may go.

So that no passage of more than ``MIN_WORDS`` words stays in part, the shortest run of lines
over that many words from each line on, and that up to each line, are spans as well (a long
line alone is one). Of a passage repeated over that many words, each line with words lies in
such a span that is repeated whole: in the one that ends with it, or, near the passage's
begin, in the one that starts the passage.

Spans are counted over all documents. Of each repeated span the occurrence in the smallest
doc_id (there the first) stays; the others go once their SHA-256 equals that of the one that
stays, unless they overlap it. A line goes only for an equal one further ahead in the order of
documents and lines, so each line stays somewhere.

Lines and spans are matched by 16 bytes of SHA-256 (a span's digest is that of its lines'), and
bytes are compared before anything goes: of all lines in matched spans, on both sides, those of
one digest must be one string, which is an aggregate over these lines only. A span that holds a
line of another kind stays. Only digests are shuffled to find matches; texts are shuffled once,
by document, to be compared and cut. A span that a third of the documents hold is one row on the
other side of a join that adaptive execution can split.

Defined results: a null text has no lines and stays null; rows with equal doc_id and text
are one document (both keep its spans, both lose the same ones), null ids included; rows with
equal doc_id and other text are ordered by a hash; a null doc_id ranks after all others; a text
may become empty, its row stays; an empty table gives an empty result; other columns pass
through, whatever their names; a very long text's spans are found in time linear in its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CHAR, let, stored

WINDOW = 2
DIVISOR = 2
MIN_LINES = 2
#: Passages of more words than this go whole.
MIN_WORDS = 50
_BASE = 1024
_FULL = (MIN_WORDS + 1) * _BASE
_LAST = 2**63 - 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def chunks_of(hashes: Column) -> Column:
    """array<struct<first,n>> of the chunks of lines with these hashes, in order; ``first`` counts from 1."""
    ends = lambda i: (i == F.size(hashes)) | (F.pmod(F.xxhash64(*(F.get(hashes, i - w) for w in range(WINDOW, 0, -1))), F.lit(DIVISOR)) == 0)

    def build(cuts):
        def one(c, k):
            first = F.coalesce(F.get(cuts, k - 1), F.lit(0)) + 1
            return F.named_struct(F.lit("first"), first, F.lit("n"), c - first + 1)

        return F.transform(cuts, one)

    return let(F.filter(F.sequence(F.lit(1), F.size(hashes)), ends), build)


def digest_of(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    """(id, row, text, whole): the columns that the work needs and, in one struct, the row's other columns as they are."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("whole")
    return df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"), whole)


def windows_of(lines: Column) -> Column:
    """array<struct<first,n>> of the shortest runs of ``lines`` over ``MIN_WORDS`` words, from each line on and up to each.

    Lines without words begin and end no run and are left out first, so a run has at most
    ``MIN_WORDS`` + 1 lines to add up.
    """

    def sums(words):
        """Per row words * _BASE + rows of the shortest run from there on, below _FULL if there is none."""
        add = lambda a, w: F.when(a < _FULL, a + w * _BASE + 1).otherwise(a)
        one = lambda i: F.aggregate(F.slice(words, i, MIN_WORDS + 1), F.lit(0).cast("long"), add)
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), one)

    def build(full):
        words = F.transform(full, lambda x: x["words"])
        # a run is its first row * _BASE + its rows
        ahead = F.transform(let(words, sums), lambda a, i: F.when(a >= _FULL, (i + 1) * _BASE + a % _BASE))
        back = F.transform(let(F.reverse(words), sums), lambda a, i: F.when(a >= _FULL, (F.size(full) - i - a % _BASE + 1) * _BASE + a % _BASE))

        def one(c):
            row, rows = (c / _BASE).cast("int"), (c % _BASE).cast("int")
            first = F.get(full, row - 1)["at"]
            return F.named_struct(F.lit("first"), first, F.lit("n"), F.get(full, row + rows - 2)["at"] - first + 1)

        return F.transform(F.array_compact(F.array_union(ahead, back)), one)

    row = lambda x, i: F.struct((i + 1).alias("at"), x["words"].alias("words"))
    return let(F.filter(F.transform(lines, row), lambda x: x["words"] > 0), build)


def spans_of(text: Column) -> Column:
    """array<struct<first,n,digest>>: chunks of at least ``MIN_LINES`` lines and windows of a text, those without words left out."""

    def of(lines):
        spans = F.array_union(F.filter(chunks_of(F.transform(lines, lambda x: x["hash"])), lambda c: c["n"] >= MIN_LINES), windows_of(lines))

        def digest(s):
            own = F.slice(lines, s["first"], s["n"])
            joined = F.array_join(F.transform(own, lambda x: F.hex(x["digest"])), "")
            return F.when(F.exists(own, lambda x: x["words"] > 0), F.named_struct(F.lit("first"), s["first"], F.lit("n"), s["n"], F.lit("digest"), digest_of(joined)))

        return F.array_compact(F.transform(spans, digest))

    words = lambda x: F.regexp_count(x, F.lit(WORD_CHAR + "+")).cast("long")
    return let(F.transform(lines_of(text), lambda x: F.struct(words(x).alias("words"), F.xxhash64(x).alias("hash"), digest_of(x).alias("digest"))), of)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, row, spans, kept): per document the spans (first line from 1, lines) that match one further ahead, and those matched."""
    occ = docs.where("text is not null").select("id", "row", F.explode(spans_of(F.col("text"))).alias("c"))
    occ = stored(occ.select("id", "row", "c.first", "c.n", "c.digest"), "span-digests")
    own = occ.groupBy("digest").agg(F.min(F.struct("id", "row", "first", "n")).alias("keep"), F.count("*").alias("c")).where("c > 1").select("digest", "keep")
    own = stored(own, "span-keepers")
    same = (F.col("id") == F.col("keep.id")) & (F.col("row") == F.col("keep.row"))
    gone = occ.join(own.hint("shuffle_hash"), "digest").where(~(same & (F.col("first") < F.col("keep.first") + F.col("n"))))
    both = gone.select("id", "row", "first", "n", F.lit(True).alias("goes")).union(own.select("keep.id", "keep.row", "keep.first", "keep.n", F.lit(False)))
    pick = lambda goes: F.collect_set(F.when(F.col("goes") == goes, F.struct("first", "n")))
    return both.groupBy("id", "row").agg(pick(True).alias("spans"), pick(False).alias("kept"))


def _numbers(spans: Column) -> Column:
    """The lines in any of the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1))))


def _matched(df: DataFrame, text: str, key: str) -> DataFrame:
    """(text, whole, spans): each row with the spans that go, their bytes compared."""
    docs = _keyed(df, text, key)
    spans = stored(repeated_spans(docs.select("id", "row", "text")), "spans-matched")
    joined = stored(docs.join(spans.hint("shuffle_hash"), ["id", "row"], "left"), "documents-matched")
    numbers = let(lines_of(F.col("text")), lambda lines: F.transform(_numbers(F.concat("spans", "kept")), lambda i: F.struct(i.alias("i"), F.get(lines, i - 1).alias("line"))))
    # the rows of one document are alike, so any of them will do
    lines = joined.where("spans is not null").select("id", "row", F.inline(numbers)).withColumn("digest", digest_of(F.col("line")))
    unlike = lines.groupBy("digest").agg(F.min("line").alias("least"), F.max("line").alias("most")).where("least != most").select("digest")
    unlike = stored(unlike, "unlike-lines")
    if unlike.isEmpty():
        return joined
    # such lines stay, with all spans that hold them
    held = lines.join(unlike.hint("shuffle_hash"), "digest", "left_semi").groupBy("id", "row").agg(F.collect_set("i").alias("held"))
    left = F.filter("spans", lambda s: ~F.exists("held", lambda i: (i >= s["first"]) & (i < s["first"] + s["n"])))
    return joined.join(stored(held, "lines-held").hint("shuffle_hash"), ["id", "row"], "left").withColumn("spans", F.when(F.col("held").isNull(), F.col("spans")).otherwise(left))


def _cut(df: DataFrame, text: str, key: str) -> DataFrame:
    """(whole, text, removed): each row of ``df``, its text without repeated spans, and the number of lines cut."""

    def rebuild(lines):
        def without(kept):
            body = F.array_join(F.transform(kept, lambda i: F.get(lines, i - 1)), "\n")
            return F.struct(body.alias("text"), (F.size(lines) - F.size(kept)).cast("long").alias("removed"))

        return let(F.array_except(F.sequence(F.lit(1), F.size(lines)), _numbers(F.col("spans"))), without)

    done = F.when(F.size("spans") > 0, let(lines_of(F.col("text")), rebuild))
    out = _matched(df, text, key).select("whole", "text", done.alias("out"))
    return out.select("whole", F.when(F.col("out").isNull(), F.col("text")).otherwise(F.col("out.text")).alias("text"), F.coalesce("out.removed", F.lit(0).cast("long")).alias("removed"))


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", removed: str = "removed_lines") -> DataFrame:
    """``df`` with repeated spans cut from ``text``, plus ``removed`` (long, a name that ``df`` hasn't), the number of lines cut."""
    if removed.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{removed} is a column already")
    return _cut(df, text, key).select(*_columns(df, text), F.col("removed").alias(removed))


def _columns(df: DataFrame, text: str) -> list[Column]:
    return [(F.col("text") if c == text else F.col(f"whole.`{c}`")).alias(c) for c in df.columns]


def clean(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``dedup_lines`` with exactly the columns of ``df``."""
    return _cut(df, text, key).select(*_columns(df, text))


def report(df: DataFrame) -> DataFrame:
    done = dedup_lines(df.select("doc_id", "text"), removed="n_lines_removed")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return done.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines_left"),
        "n_lines_removed",
        "text",
    )
