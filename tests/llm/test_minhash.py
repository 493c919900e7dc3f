import random
import re

import numpy as np
import pytest
from pyspark.sql import Row

from tallyrank.llm import minhash
from tallyrank.llm.components import connected


def brute(docs, k=4, percent=80):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(5))
    out, bases = [], []
    for i in range(n):
        r = rng.random()
        if bases and r < 0.6:
            w = list(rng.choice(bases[:6] if r < 0.4 else bases))
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([1, 2, 3, 4, 5, 40, 120]))]
            bases.append(w)
        out.append((i, (" " if rng.random() < 0.5 else "\n").join(w)))
    return out + [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "\xa0"), (n + 4, "x " * 20000), (n + 5, "X " * 20000)]


def check(got, want):
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


@pytest.mark.parametrize("region,pivots,shingles", [(128, 16, 1_000_000), (8, 2, 1_000_000), (8, 0, 300)])
def test_equals_brute_force(spark, monkeypatch, region, pivots, shingles):
    monkeypatch.setattr(minhash, "REGION", region)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(minhash.near_duplicates(df).collect(), brute(docs))


def test_odd_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([Row(doc_id=5, text=t, kept=1, n=2), Row(doc_id=5, text=t, kept=1, n=2), Row(doc_id=None, text=t, kept=0, n=1), Row(doc_id=2, text=t.upper(), kept=1, n=3)])
    got = sorted(minhash.near_duplicates(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(2, 2, True), (5, 2, False), (5, 2, False), (None, None, True)]
    assert sorted(r.n for r in minhash.keep_one(df).collect()) == [1, 3]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    assert minhash.keep_one(df).columns == ["doc_id", "text"]


def test_connected_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_cut_regions_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TREES", 2)  # few trees, so that a link lost in one isn't found in another
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(203)]
    docs = []
    for i in range(60):  # near copies, so the regions of all trees are cut to the full depth
        w = list(base)
        w[0 if i % 2 else -1] = word()
        docs.append((i, " ".join(w)))
    for i in range(200):  # members at a similarity near 0.81: 5 changed words, 4 shingles each
        w = list(base)
        for at in range(20, 200, 36):
            w[at + rng.randrange(12)] = word()
        docs.append((1000 + i, " ".join(w)))
    df, found = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), []
    for region in (4096, 16):
        monkeypatch.setattr(minhash, "REGION", region)
        found.append({r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()})
    assert found[0] == found[1]


def test_same_id_with_other_text(spark):
    a, b = "one two three four five six seven", "red orange yellow green blue indigo violet"
    df = spark.createDataFrame([(1, a), (1, b), (4, a), (3, b), (9, "no copies of this text")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (4, 1), (3, 1), (9, 9)}


def test_exact_sets_pass_over_nothing():
    rng = random.Random(3)
    base = [rng.randrange(2**64) for _ in range(3000)]
    sets = []
    for _ in range(60):
        keep = rng.choice([0.3, 0.78, 0.88, 0.9, 0.95, 1.0])
        sets.append({x for x in base if rng.random() < keep} | {rng.randrange(2**64) for _ in range(rng.choice([0, 100, 300]))})
    sets += [set(base[:n]) for n in (1, 2, 4, 5, 800, 1000)]
    got = minhash._Sets.__new__(minhash._Sets)
    got.fill([np.array(sorted(x), np.uint64) for x in sets], 80)
    for i, x in enumerate(sets):
        rest = np.array([j for j in range(len(sets)) if j != i])
        want = [100 * len(x & sets[j]) >= 80 * len(x | sets[j]) for j in rest]
        assert got.near(i, rest).tolist() == want
