import random

import pytest
from pyspark.sql import Row
from pyspark.sql.functions import lit as d_lit

from tallyrank.llm import decontaminate as d


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        r = rng.random()
        if r < 0.34:
            s[i] = rng.choice("abcd ")
        elif r < 0.67:
            del s[i]
        else:
            s.insert(i, rng.choice("abcd "))
    return "".join(s)


def test_myers_equals_dynamic_programme():
    rng = random.Random(5)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        best, end = d.myers(d.masks(p), len(p), t)
        assert best == distance(p, t)
        assert distance(p, t[:end]) == best


def alone(item, text):
    """Whether a short item stands in a text as whole words."""
    at = [i for i in range(len(text)) if text.startswith(item, i)]
    return any(not (text[i - 1 : i] if i else "").isalnum() and not text[i + len(item) : i + len(item) + 1].isalnum() for i in at)


def found(item, text):
    return alone(item, text) if d.budget(len(item)) == 0 else distance(item, text) <= d.budget(len(item))


def cases(n=300):
    rng = random.Random(8)
    item = lambda m: d.normal("".join(rng.choice("abcdefgh  ") for _ in range(m)))
    items = [(i, item(rng.choice([5, 30, 60, 120, 300]))) for i in range(12)]
    docs = []
    for i in range(n):
        filler = item(rng.randint(0, 200))
        if rng.random() < 0.7:
            text = rng.choice(items)[1]
            filler += " " + edited(rng, text, rng.randint(0, int(0.08 * len(text)) + 1)).upper() + "\n\t" + item(50)
        docs.append((i, filler))
    return docs, items


@pytest.mark.parametrize("block", [d.BLOCK_CHARS, 300])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_CHARS", block)
    docs, items = cases()
    want = {(i, j): distance(p, d.normal(t)) for i, t in docs for j, p in items if p and found(p, d.normal(t))}
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in d.report(dd, ii).collect()}
    assert got == want
    assert {r.doc_id for r in d.clean(dd, ii).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    for r in d.find_matches(dd, ii).collect():
        text = d.normal(docs[r.doc_id][1])[r.start : r.end]
        assert distance(dict(items)[r.item_id], text) == r.distance


def test_odd_rows(spark):
    docs = spark.createDataFrame([Row(doc_id=None, text="x the quick brown fox y", item_id=3), Row(doc_id=1, text=None, item_id=3), Row(doc_id=2, text="", item_id=None)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(7, "The  quick\nbrown fox"), (7, "The  quick\nbrown fox"), (8, None), (9, " ")], "item_id long, text string")
    got = d.find_matches(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(None, 7, 0)] * 2
    assert d.clean(docs, items).columns == docs.columns and d.clean(docs, items).count() == 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_matches(docs, none).count() == 0 and d.clean(docs, none).count() == 3
    assert d.report(docs.limit(0), items).count() == 0


def test_rows_report_alone(spark):
    docs = spark.createDataFrame([(None, "a the quick brown fox"), (None, "b the quick brown fox"), (1, "the quick brown fox"), (1, "the quick brown fox"), (1, "see the quick brown fox, the quick brown fox")], "doc_id long, text string").withColumn("best", d_lit(1))
    items = spark.createDataFrame([(7, "The  quick\nbrown fox")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.start) for r in d.report(docs.repartition(3), items).collect()) == [("1", 0), ("1", 0), ("1", 4), ("None", 2), ("None", 2)]


def test_short_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "another theme"), (2, "In THE end"), (3, "other, the"), (4, "the")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert {r.doc_id for r in d.report(docs, items).collect()} == {2, 3, 4} and [r.doc_id for r in d.clean(docs, items).collect()] == [1]


def test_very_long_text(spark):
    item = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "lorem ipsum " * 300_000 + item.replace("word7 ", "wrd7 ")), (2, "lorem ipsum " * 300_000)], "doc_id long, text string")
    (r,) = d.report(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert (r.doc_id, r.distance, r.start) == (1, 1, 3_600_000)
