"""How often the neighbour search sends its queries, and what it does with copies."""

import numpy as np

from tallyrank.functions import order
from tallyrank.operators import benchmark, near, protocol
from tallyrank.operators import detectors as det


def nearest_of(m, k):
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {(i, r + 1): int(j) for i in range(len(m)) for r, j in enumerate(np.lexsort((np.broadcast_to(np.arange(len(m)), d.shape), d), axis=1)[i, :k])}


def frame(spark, m):
    return spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(m)], "task int, id long, v array<double>")


def test_queries_travel_once_a_chunk(spark, monkeypatch):
    """Where nothing can be pruned a block meets each chunk of rings, not each ring: 2 passes, 3 chunks, about 4 blocks."""
    monkeypatch.setattr(near, "LEAST", 200, raising=False)
    monkeypatch.setattr(near, "CHUNKS", 3, raising=False)
    m = np.random.default_rng(4).normal(size=(700, 24))
    m /= np.linalg.norm(m, axis=1)[:, None]
    report = {}
    got = near.nearest(frame(spark, m), frame(spark, m), 4, report=report, size=175).collect()
    assert {(r.id, r["rank"]): r.other for r in got} == nearest_of(m, 4)
    assert report["blocks"] <= 2 * 4 * 4


def test_lof_searches_once(spark):
    m = np.random.default_rng(5).normal(size=(60, 3))
    rows = spark.createDataFrame([(i, True, v.tolist()) for i, v in enumerate(m)], "id long, train boolean, v array<double>")
    plan = det.lof(rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan  # the neighbours are read, not searched anew for each use


def test_cover_searches_vectors_once(spark, monkeypatch):
    """40 copies each of points 0, 1, ..., 5 apart by 1: every second point is kept, and copies aren't paired."""
    searched, real = [], near.within
    monkeypatch.setattr(near, "within", lambda rows, radius: searched.append(rows.count()) or real(rows, radius))
    rows = spark.createDataFrame([(7, 40 * i + j, [float(i), 0.0]) for i in range(6) for j in range(40)], "dataset int, id long, v array<double>")
    assert [(r.dataset, r.n_eff) for r in benchmark.greedy_cover(rows, 1.0).collect()] == [(7, 3)] and searched == [6]


def test_copies_are_searched_once(spark):
    """30 copies each of 40 points: no more pairs than those of the 40 points take, and each row's neighbours are the first of its copies."""
    m = np.random.default_rng(7).normal(size=(40, 2))
    rows = spark.createDataFrame([(0, i, m[i % 40].tolist()) for i in range(1200)], "task int, id long, v array<double>")
    report = {}
    got = near.nearest(rows, rows, 3, report=report).collect()
    want = {(i, r + 1): j for i in range(1200) for r, j in enumerate([j for j in range(i % 40, 1200, 40) if j != i][:3])}
    assert {(r.id, r["rank"]): r.other for r in got} == want and report["pairs"] <= 2 * 40 * 40


def test_pseudo_tasks_are_dealt_where_rows_are_read(spark, monkeypatch):
    kept = []
    for module in (protocol, order):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, real=real: kept.append(out := real(df, name)) or out)
    m = np.random.default_rng(8).normal(size=(400, 2))
    rows = spark.createDataFrame([(i, i % 20, d, float(m[i, d])) for i in range(400) for d in range(2)], "id long, cluster int, dim int, x double")
    tasks = protocol.cluster_tasks(rows, 6, ("smallest", "random")).groupBy("how", "draw", "role").count().collect()
    by = {(r.how, r.draw, r.role): r["count"] for r in tasks}
    assert len(by) == 36 and all(by[h, d, "pnorm"] == max(50, int((by[h, d, "pnorm"] + by[h, d, "train"]) * 0.2)) and sum(by[h, d, r] for r in ("train", "pnorm", "panom")) == 400 for h, d, _ in by)
    tables = [t for t in kept if "id" in t.columns]
    assert tables and max(t.count() for t in tables) <= 400  # no row a task
