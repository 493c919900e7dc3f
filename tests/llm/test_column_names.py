"""Operators that pass columns through, on tables whose columns have the operators' own names."""

import random

import pytest
from pyspark.sql import functions as F

from tallyrank.llm import line_dedup, minhash

NAMES = "__id __row __out __spans __removed __gone gone id row whole spans kept keep digest first n out removed removed_lines held line i least most node component cluster block Whole_".split()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = "\n".join(line(20) for _ in range(5))
    texts = [line(30), "x\n" + passage, passage + "\ny", passage + "\ny z", None, "", "end " + line(9)]
    df = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for c in NAMES:
        df = df.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df.repartition(3)


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_line_dedup_keeps_every_column(odd):
    got, want = line_dedup.clean(odd), rows_of(odd)
    assert got.columns == odd.columns
    for d, r in rows_of(got).items():
        assert {c: r[c] for c in NAMES} == {c: want[d][c] for c in NAMES}
    texts = {d: r["text"] for d, r in rows_of(got).items()}
    assert texts[1] == want[1]["text"] and (texts[2], texts[3]) == ("y", "y z") and texts[4] is None and texts[None] == ""
    counted = rows_of(line_dedup.dedup_lines(odd, removed="cut"))
    assert {d: r["cut"] for d, r in counted.items()} == {0: 0, 1: 0, 2: 5, 3: 5, 4: 0, None: 0, 6: 0}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(odd, removed="Removed")


def test_near_dedup_keeps_every_column(odd):
    rows = odd.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("same words in both of these texts")).when(F.col("doc_id") == 6, F.lit("SAME words in both of these texts")).otherwise(F.col("text")))
    got, want = rows_of(minhash.keep_one(rows)), rows_of(rows)
    assert minhash.keep_one(rows).columns == rows.columns and set(got) == set(want) - {2, 6}
    assert all(got[d] == want[d] for d in got)


def test_equal_digests_are_compared_by_bytes(spark, monkeypatch):
    """With a digest of four bits lines collide; whatever goes still stands in an earlier place."""
    monkeypatch.setattr(line_dedup, "digest_of", lambda data: F.substring(F.sha1(data), 1, 1).cast("binary"))
    rng = random.Random(2)
    docs = [(i, "\n".join(" ".join(rng.choice("abcdef") * 3 + str(rng.randrange(9)) for _ in range(13)) for _ in range(6))) for i in range(12)]
    got = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    left = {x for t in got.values() for x in t.split("\n")}
    assert {x for _, t in docs for x in t.split("\n")} <= left
