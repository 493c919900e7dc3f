"""The filter audit against running every order."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyrank.llm import filter_audit


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for d, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        rows.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            own = left
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for i in range(150):
        w = [word() if rng.random() < 0.7 else "the" for _ in range(rng.choice([0, 3, 150, 199, 200, 260]))]
        if rng.random() < 0.3:
            w = w[:5] * 60
        t = " ".join(w)
        t = t.upper() if rng.random() < 0.2 else t
        t = t + " #" if rng.random() < 0.3 else t
        t = docs[rng.randrange(i)][1] if i and rng.random() < 0.3 else t
        docs.append((i, t, rng.choice(["x", "y", None])))
    docs += [(None, docs[3][1], "x"), (None, None, "x"), (500, None, ""), (500, None, ""), (501, "", "z"), (3, docs[3][1], "x"), (502, "\xa0é漢 Z", "y"), (503, "w " * 60000, "y")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)] + [(4, 1, None), (4, 0, True), (None, 1, True), (9, None, None)]
    return docs, [(d, q, None if x is None else int(x)) for d, q, x in labels]


def test_equals_running_every_order(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    for c in ("part", "A", "E", "f0", "n", "good", "toxic", "digest", "first", "id", "subset", "filter"):
        df = df.withColumn(c, F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("good", F.lit(1))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.report(df, marks).collect()}
    assert got == brute(docs, labels)


def test_whole_table_and_other_flags(spark):
    df = spark.createDataFrame([("p", True, None, 1, 0), ("q", False, True, 0, 1), (None, False, False, 1, 1)], "part string, long boolean, odd boolean, good int, toxic int")
    found = {(r.part, r.subset): r.n for r in filter_audit.survivors(df, ["long", "odd"]).collect()}
    assert found == {(None, 0): 3, (None, 1): 2, (None, 2): 2, (None, 3): 1, ("p", 0): 1, ("p", 2): 1, ("q", 0): 1, ("q", 1): 1, ("", 0): 1, ("", 1): 1, ("", 2): 1, ("", 3): 1}
    rows = filter_audit.audit(df, ["long", "odd"]).collect()
    assert len(rows) == 3 * 2 * 2 and all(r.shapley == 2 for r in rows if r.part == "p" and r.filter_order == "longodd" and r.step == 1)
    with pytest.raises(ValueError):
        filter_audit.audit(df, [])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.report(docs, labels).count() == 0
    assert filter_audit.report(spark.createDataFrame([(1, None, None)], docs.schema), labels).count() == 600
