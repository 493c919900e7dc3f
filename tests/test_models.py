"""Model tables: fitted, stored and scored in another session, task by task, against the one-pass detectors and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.functions.scratch import scratch
from tallyrank.operators import detectors as det
from tallyrank.operators import models, near

NAMES = list(models.DETECTORS)


def data(spark):
    rng = np.random.default_rng(4)
    out = {}
    for task, n in (("a", 400), ("b", 150)):
        centres = rng.normal(0, 5, (4, 6))
        m = centres[rng.integers(0, 4, n)] + rng.normal(0, 1, (n, 6)) * [1, 1, 1, 1, 0.1, 0]
        m[:, 3] = np.round(m[:, 3])  # ties
        q = np.vstack([m[:20] + rng.normal(0, 0.2, (20, 6)), rng.normal(0, 9, (20, 6))])
        out[task] = m, q
    frame = lambda i: spark.createDataFrame([(t, k, v.tolist()) for t, p in out.items() for k, v in enumerate(p[i])], "task string, id long, v array<double>").repartition(3)
    return out, frame(0), frame(1)


@pytest.fixture(scope="module")
def found(spark):
    plain, train, rows = data(spark)
    path = models.fit(train, NAMES, scratch(spark, "models-test"))
    other = spark.newSession()
    again = other.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)
    got = {}
    for r in models.score(again, path, NAMES).collect():
        got.setdefault((r.task, r.detector), {})[r.id] = r.score
    return plain, path, got


LONG = {"maxz": det.max_z, "centroid": det.centroid_distance, "hbos": det.hbos, "ecod": det.ecod, "copod": det.copod, "severity": det.severity}
WIDE = {"knn": det.knn, "knn_mean": det.knn_mean, "lof": det.lof, "pca": det.pca_score, "linear_residual": det.linear_residual, "loda": det.loda}


@pytest.mark.parametrize("name", [*LONG, *WIDE])
def test_equals_one_pass(spark, found, name):
    plain, _, got = found
    for task, (m, q) in plain.items():
        rows = [(2 * i, True, v.tolist()) for i, v in enumerate(m)] + [(2 * i + 1, False, v.tolist()) for i, v in enumerate(q)]
        df = spark.createDataFrame(rows, "id long, train boolean, v array<double>")
        want = {r.id: r.score for r in (LONG[name](det.long_form(df)) if name in LONG else WIDE[name](df)).collect() if r.id % 2}
        assert got[task, name] == pytest.approx({(i - 1) // 2: s for i, s in want.items()}, rel=1e-7, abs=1e-9)


def test_forest_equals_its_trees(spark, found):
    plain, path, got = found
    table = spark.read.parquet(f"{path}/iforest/trees").collect()
    for task, (m, q) in plain.items():
        own = [t for t in table if t.task == task]
        assert len(own) == models.FOREST and all(t.size == min(256, len(m)) for t in own)

        def deep(t, v):
            i = 0
            while t.feature[i] >= 0:
                i = t.below[i] if v[t.feature[i]] < t.cut[i] else t.above[i]
            return t.depth[i]

        c = float(models.average_path(own[0].size))
        want = {i: 2 ** (-np.mean([deep(t, v) for t in own]) / c) for i, v in enumerate(q)}
        assert got[task, "iforest"] == pytest.approx(want)
        assert np.mean([want[i] for i in range(20)]) + 0.05 < np.mean([want[i] for i in range(20, 40)])
        # every leaf's rows are those of the sample: depths of one tree agree with its sizes
        assert all(len(t.feature) == len(t.cut) == len(t.below) and sum(f >= 0 for f in t.feature) * 2 + 1 == len(t.feature) for t in own)


def lloyd(m, centres, rounds=20):
    for _ in range(rounds):
        own = np.sqrt(((m[:, None] - centres[None]) ** 2).sum(2)).argmin(1)
        new = np.array([m[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        if np.abs(new - centres).max() <= 1e-9:
            break
        centres = new
    return centres, np.sqrt(((m[:, None] - centres[None]) ** 2).sum(2)).argmin(1)


def first_centres(spark, m, k, seed=0):
    from tallyrank.functions.ranks import hash_order

    ids = [r.id for r in spark.range(len(m)).orderBy(hash_order(F.lit(seed), F.lit("centre"), "id"), "id").limit(k).collect()]
    return m[ids]


def test_kmeans_of_many_tasks_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 64)
    plain, train, _ = data(spark)
    ks = spark.createDataFrame([("a", 3), ("a", 7), ("b", 3)], "task string, k int")
    labels, centres = models.kmeans(train, ks)
    got = {}
    for r in labels.collect():
        got.setdefault((r.task, r.k), {})[r.id] = r.cluster
    for r in centres.collect():
        m = plain[r.task][0]
        want, own = lloyd(m, first_centres(spark, m, r.k))
        assert np.allclose(np.array(r.centres).reshape(r.n, -1), want)
        assert [got[r.task, r.k][i] for i in range(len(m))] == own.tolist()


def test_cblof_equals_numpy(spark, found):
    plain, _, got = found
    for task, (m, q) in plain.items():
        centres, own = lloyd(m, first_centres(spark, m, 8))
        size = np.bincount(own, minlength=8)
        order, keep, run = sorted((c for c in range(8) if size[c]), key=lambda c: (-size[c], c)), [], 0
        for i, c in enumerate(order):
            keep.append(c)
            run += size[c]
            after = size[order[i + 1]] if i + 1 < len(order) else 0
            if run >= 0.9 * len(m) or (after and size[c] / after >= 5):
                break
        want = np.sqrt(((q[:, None] - centres[keep][None]) ** 2).sum(2)).min(1)
        assert got[task, "cblof"] == pytest.approx(dict(enumerate(want.tolist())))


@pytest.mark.parametrize("shape", ["clusters", "line", "same"])
def test_nearest_equals_all_pairs(spark, monkeypatch, shape):
    monkeypatch.setattr(near, "RING", 16)
    monkeypatch.setattr(near, "BLOCK", 100)
    rng = np.random.default_rng(2)
    m = {"clusters": rng.normal(0, 20, (9, 5))[rng.integers(0, 9, 700)] + rng.normal(0, 0.5, (700, 5)), "line": np.arange(700.0)[:, None] ** 1.5, "same": np.repeat(rng.normal(0, 1, (3, 4)), 100, axis=0)}[shape]
    q = np.vstack([m[:50], m[:30] + 0.01, rng.normal(0, 30, (20, m.shape[1]))])
    frame = lambda x, at: spark.createDataFrame([(5, at + i, v.tolist()) for i, v in enumerate(x)], "task int, id long, v array<double>")
    got = [(r.id, r.other, round(r.distance, 9), r["rank"]) for r in near.nearest(frame(q, 0), frame(m, 0), 4).collect()]
    want = []
    for i, v in enumerate(q):
        d = np.sqrt(((m - v) ** 2).sum(1))
        d[i] = np.inf  # the row of its own id
        want += [(i, int(j), round(float(d[j]), 9), k + 1) for k, j in enumerate(np.lexsort((np.arange(len(m)), d))[:4])]
    assert sorted(got) == sorted(want)


def test_pruned_search_takes_few_distances(spark):
    """200,000 clustered rows: under a tenth of all pairs."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 10, (200, 16))
    n, blocks = 200_000, 100

    def make(batches):
        import pandas as pd

        for batch in batches:
            for b in batch["id"]:
                r = np.random.default_rng(int(b))
                m = centres[r.integers(0, 200, n // blocks)] + r.normal(0, 0.5, (n // blocks, 16))
                yield pd.DataFrame({"task": 0, "id": np.arange(len(m)) + int(b) * len(m), "v": m.tolist()})

    rows = spark.range(blocks).mapInPandas(make, "task int, id long, v array<double>")
    path = scratch(spark, "near-test")
    rows.write.parquet(path)
    rows, report = spark.read.parquet(path), {}
    queries = rows.where("id < 4000")
    assert near.nearest(queries, rows, 5, report=report).count() == 20_000
    assert report["pairs"] < 0.1 * 4000 * n


def test_detectors_of_few_rows(spark):
    train = spark.createDataFrame([("x", 1, [1.0, 2.0]), ("x", 2, [1.0, 3.0]), ("y", 1, [0.0, 0.0])], "task string, id long, v array<double>")
    path = models.fit(train, ["maxz", "hbos", "ecod", "severity", "cblof", "iforest"])
    rows = spark.createDataFrame([("x", 9, [1.0, 9.0]), ("y", 9, [1.0, 1.0]), ("none", 9, [1.0, 1.0])], train.schema)
    got = models.score(rows, path, ["maxz", "ecod", "severity", "cblof", "iforest"]).collect()
    assert {r.task for r in got} == {"x", "y"} and all(np.isfinite(r.score) for r in got)
    assert models.score(rows.limit(0), path, ["maxz", "knn_mean"][:1]).count() == 0
