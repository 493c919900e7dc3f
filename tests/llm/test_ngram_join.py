"""The n-gram join against all pairs, its bounds and derived answers against plain sets."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import minhash, ngram_join
from tests.llm.test_minhash import brute


def corpus(seed=2):
    """Chains of copies around the similarity, passages that many share, very short and equal texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [[word() for _ in range(30)] for _ in range(3)]
    out, bases = [], []
    for i in range(500):
        if bases and rng.random() < 0.65:
            w = list(rng.choice(bases[:5] if rng.random() < 0.6 else bases))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.5:
                bases.append(w)
        else:
            w = [word() for _ in range(rng.choice([1, 2, 3, 4, 20, 60, 150]))] + (rng.choice(shared) if rng.random() < 0.6 else [])
            bases.append(w)
        out.append((i, " ".join(w) if rng.random() < 0.8 else "\n".join(w).upper()))
    return out + [(600, ""), (601, None), (602, " \t"), (603, "\xa0"), (604, "x " * 5000), (605, "one Two"), (606, "ONE\ttwo")]


@pytest.mark.parametrize("region,pivots,shingles,many", [(128, 16, 1_000_000, 1024), (8, 2, 1_000_000, 50), (8, 0, 300, 0)])
def test_equals_all_pairs(spark, monkeypatch, region, pivots, shingles, many):
    monkeypatch.setattr(minhash, "REGION", region)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for c in ("id", "n", "prefix", "region", "node", "classes", "pos", "kept", "component_id"):
        df = df.withColumn(c, F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.report(df).collect()}
    want = brute(docs, 3, 90)
    assert got == {d: v[:2] for d, v in want.items()}
    assert sum(v[1] != d for d, v in want.items()) > 80


def sets_of(rng, n, size, most):
    base, out = rng.integers(0, 2**64, size, dtype=np.uint64), []
    for _ in range(n):
        drop = rng.integers(0, most)
        s = np.concatenate([rng.permutation(base)[drop:], rng.integers(0, 2**64, rng.integers(0, most), dtype=np.uint64)])
        out.append(np.unique(s))
    return out


def entries_near(entries, x, y):
    i, j = (int(np.flatnonzero(entries.nodes == z)[0]) for z in (x, y))
    return bool(entries.near(i, np.array([j]))[0])


@pytest.mark.parametrize("size,most", [(8, 3), (60, 12), (1500, 200), (3000, 400)])
def test_bounds_lose_no_link_and_answers_are_exact(size, most):
    rng = np.random.default_rng(size)
    sets, percent = sets_of(rng, 60, size, most), 90
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    sizes = np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (sizes[:, None] + sizes - both)
    counts = rng.integers(0, 5, ngram_join.BUCKETS)
    by_class = ngram_join.Classes(sizes, [ngram_join.classes(s) for s in sets])
    everything = np.arange(len(sets))
    first = [ngram_join.prefix(s, counts, percent) for s in sets]
    found = np.eye(len(sets), dtype=bool)
    for i in everything:
        assert (by_class.near(i, everything, percent) >= linked[i]).all()
    for token in np.unique(np.concatenate(first)):
        rows = [(i, len(sets[i]), int(np.flatnonzero(f == token)[0]), ngram_join.classes(sets[i])) for i, f in enumerate(first) if token in f]
        entries = ngram_join.Lists(pd.DataFrame(rows, columns=["node", "n", "pos", "classes"]), percent)
        for i in range(len(rows)):
            hit = entries.near(i, np.arange(len(rows)))
            found[entries.nodes[i], entries.nodes[hit]] = True
        frame = pd.DataFrame(rows, columns=["node", "n", "pos", "classes"]).head(ngram_join.FEW)
        a, b = ngram_join.few_linked(frame, np.array([0]), np.array([len(frame)]), percent)
        pairs = set(zip(frame["node"].to_numpy()[a].tolist(), frame["node"].to_numpy()[b].tolist(), strict=True))
        mine = set(frame["node"].tolist())
        assert pairs == {(x, y) for x in mine for y in mine if x < y and entries_near(entries, x, y)}
    assert (found >= linked).all() and linked.sum() > len(sets)
    index = ngram_join.Answers.__new__(ngram_join.Answers)
    index.fill(sets, percent)
    whole = index.list_at[-1]
    for i in everything:
        assert (index.answers(i) == both[i]).all()
        assert (index.near(i, everything) == linked[i]).all()
    # answers of similar sets are derived: less is read than by reading each set's lists
    assert index.read < 2 * (sizes[:, None] * 0 + both).sum() and whole == sizes.sum()


def test_derived_answers_read_less():
    rng = np.random.default_rng(1)
    sets = sets_of(rng, 40, 2000, 20)
    index = ngram_join.Answers.__new__(ngram_join.Answers)
    index.fill(sets, 90)
    for i in range(40):
        index.answers(i)
    assert index.read < 0.1 * 40 * 40 * 2000


def test_rare_shingles_come_first():
    counts = np.zeros(ngram_join.BUCKETS, np.int64)
    s = np.sort(np.random.default_rng(0).integers(0, 2**64, 100, dtype=np.uint64))
    counts[ngram_join._bucket(s[:50])] = 9
    assert len(ngram_join.prefix(s, counts, 90)) == 11 and set(ngram_join.prefix(s, counts, 90)) <= set(s[50:])


def test_empty_and_nulls(spark):
    assert ngram_join.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (1, "A b C d"), (1, "A b C d"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in ngram_join.report(df).collect()), key=str)
    assert got == [(0, None), (0, None), (1, 1), (1, 1), (2, 1)]
