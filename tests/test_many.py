"""Many data sets in one job: pseudo-tasks against numpy, forests against their definition, cover, exact tests, quantiles and running sums."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.functions import order, stats
from tallyrank.functions.metrics import roc_auc
from tallyrank.operators import benchmark, detectors as det, models, protocol, windows
from tests.test_models import first_centres, lloyd


def md5(*parts):
    return hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()


def composite(z, own, k):
    """(size, far, composite) by cluster."""
    ids = [c for c in range(k) if (own == c).any()]
    centre = {c: z[own == c].mean(0) for c in ids}
    size = {c: int((own == c).sum()) for c in ids}
    far = {c: np.mean(sorted(np.linalg.norm(centre[c] - centre[o]) for o in ids if o != c)[:3]) for c in ids}
    loose = {c: np.linalg.norm(z[own == c] - centre[c], axis=1).mean() for c in ids}

    def scaled(x):
        lo, hi = min(x.values()), max(x.values())
        return {c: (v - lo) / (hi - lo) if hi > lo else 0.0 for c, v in x.items()}

    return ids, size, scaled(far)


def test_pseudo_tasks_of_many_data_sets_equal_numpy(spark):
    rng = np.random.default_rng(5)
    plain = {}
    for name, n in (("a", 160), ("b", 240), ("c", 100), ("d", 130), ("e", 90)):
        centres = rng.normal(0, 6, (6, 3))
        plain[name] = centres[rng.integers(0, 6, n)] + rng.normal(0, 1, (n, 3))
    rows = spark.createDataFrame([(t, i, v.tolist()) for t, m in plain.items() for i, v in enumerate(m)], "dataset string, id long, v array<double>").repartition(4)
    bank, m, seed = [("smallest", 30), ("hard", 30), ("random", 6)], 3, 2
    got = {(r.dataset, r.detector, r.regime, r.subset): r.pseudo_auc for r in protocol.pseudo_fact(rows, ("maxz", "centroid"), bank, m, seed).collect()}
    want = {}
    for name, x in plain.items():
        n = len(x)
        std = (x - x.mean(0)) / x.std(0)
        values, vectors = np.linalg.eigh(np.cov(x.T, bias=True) / np.outer(x.std(0), x.std(0)))
        vectors = vectors[:, ::-1]
        z = std @ (vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(3)]))
        for how, nominal in bank:
            k = min(nominal, max(2, n // 20))
            _, own = lloyd(z, first_centres(spark, z, k, seed))
            ids, size, far = composite(z, own, k)
            keep = ids if how == "random" else sorted(ids, key=lambda c: ((size if how == "smallest" else far)[c], c))[: max(2, len(ids) // 2)]
            for draw in range(m):
                out, held = [], 0
                for c in sorted(keep, key=lambda c: md5(seed, draw, c)):
                    if held < max(20, int(n * 0.05)):
                        out.append(c)
                        held += size[c]
                rest = sorted((i for i in range(n) if own[i] not in out), key=lambda i: md5(seed, "pnorm", f"{name}|{k}||{how}", draw, i))
                most = min(max(50, int(0.2 * len(rest))), len(rest) // 3)
                norm, train, anom = rest[:most], rest[most:], [i for i in range(n) if own[i] in out]
                if min(len(anom), len(norm)) < 3 or len(train) < 20:
                    continue
                mu, sd = x[train].mean(0), x[train].std(0)
                for d, s in (("maxz", np.abs((x - mu) / (sd + 1e-9)).max(1)), ("centroid", np.linalg.norm(x - mu, axis=1))):
                    s = np.round(s, 9)
                    want[name, d, f"{how}_K{nominal}", draw] = np.mean([(s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in anom for j in norm])
    assert set(got) == set(want) and got == pytest.approx(want) and len({k[0] for k in want}) == 5


def test_evaluate_all_data_sets(spark):
    rng = np.random.default_rng(6)
    data = []
    for name in ("p", "q"):
        m = rng.normal(0, 1, (400, 3))
        m[360:] *= 6
        data += [(name, i, "train" if i < 200 else "val" if i < 280 else "test", int(i >= 360), m[i].tolist()) for i in range(400)]
    rows = spark.createDataFrame(data, "dataset string, id long, role string, y int, v array<double>")
    names = ("maxz", "centroid", "knn", "pca")
    got = protocol.evaluate_all(rows, names, 500).collect()
    assert {(r.dataset, r.detector) for r in got} == {(d, n) for d in "pq" for n in names}
    for r in got:
        alone = next(x for x in protocol.evaluate(rows.where(F.col("dataset") == r.dataset).drop("dataset"), names, 500).where(F.col("detector") == r.detector).collect()) if r.detector == "maxz" else None
        assert r.auc > 0.9 and r.separability is not None and 0 <= r.hits <= 1
        if alone:
            assert (r.auc, r.ap_norm, r.consensus, r.centrality, r.hits) == pytest.approx((alone.auc, alone.ap_norm, alone.consensus, alone.centrality, alone.hits))
    rule = {r.dataset: r.rule_auc for r in protocol.rule_auc(rows).collect()}
    assert all(v > 0.9 for v in rule.values()) and len(rule) == 2


def test_most_stable_and_random_forests(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(0, 1, (120, 4))
    m[100:] += 4
    frame = lambda ids: spark.createDataFrame([("x", i, m[i].tolist(), int(i >= 100)) for i in ids], "dataset string, id long, v array<double>, y int")
    train, test = frame(range(60)), frame(range(60, 120))
    grid = protocol._forest_grid(train, test, (0.5, 1.0), (5, 20), (0, 1, 2))
    scores = {}
    for r in grid.collect():
        scores.setdefault((r.features, r.trees), {}).setdefault(r.seed, {})[r.id] = r.score
    rank = lambda s: np.array([sum(x < v for x in s) + (sum(x == v for x in s) + 1) / 2 for v in s])
    stable = {c: np.median([np.corrcoef(rank([s[a][i] for i in range(60, 120)]), rank([s[b][i] for i in range(60, 120)]))[0, 1] for a, b in ((0, 1), (0, 2), (1, 2))]) for c, s in scores.items()}
    assert {(r.features, r.trees): r.stability for r in protocol.seed_stability(grid).collect()} == pytest.approx(stable)
    got = protocol.most_stable(train, test, test, (5, 20), (0.5, 1.0)).collect()[0]
    assert (got.features, got.trees) == max(stable, key=lambda c: stable[c]) and got.regret >= 0
    one = protocol.random_forest_choice(train, test, test, (5, 20), (0.5, 1.0), least=4).collect()[0]
    ap = [r.ap_norm for r in protocol._config_ap(protocol._forest_grid(train, test, (0.5, 1.0), (5, 20), (0,)), test).collect()]
    assert one.n == 4 and (one.ap_norm, one.regret) == pytest.approx((np.mean(ap), max(ap) - np.mean(ap)))
    assert protocol.random_forest_choice(train, test, test, (5,), (0.5,), least=4).count() == 0


def test_cover_equals_the_pass(spark):
    rng = np.random.default_rng(8)
    sets = {1: rng.uniform(0, 1, (300, 2)), 2: np.cumsum(np.full((60, 2), 0.05), axis=0), 3: np.zeros((5, 2))}
    rows = spark.createDataFrame([(t, i, v.tolist()) for t, m in sets.items() for i, v in enumerate(m)], "dataset int, id long, v array<double>").repartition(3)
    got = {r.dataset: r.n_eff for r in benchmark.greedy_cover(rows, 0.11).collect()}
    for t, m in sets.items():
        kept = []
        for v in m:
            if all(np.sqrt(((v - k) ** 2).sum()) > 0.11 for k in kept):
                kept.append(v)
        assert got[t] == len(kept)


@pytest.mark.parametrize("values", [[1, -2, 3, 4, -5, 6], [1, 1, -1, 2, 2, 5], [3], [-1.5, 2.5, 0, None]])
def test_exact_signed_ranks_equal_enumeration(spark, values):
    df = spark.createDataFrame([("g", None if v is None else float(v)) for v in values], "g string, d double")
    got = stats.wilcoxon_exact(df, ["g"], "d").collect()[0]
    d = [v for v in values if v]
    a = np.abs(d)
    rank = np.array([sum(a < x) + (sum(a == x) + 1) / 2 for x in a])
    sums = np.array([sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))])
    w = min(rank[np.array(d) > 0].sum(), rank[np.array(d) < 0].sum())
    assert got.n == len(d) and got.p_exact == pytest.approx(min(1.0, 2 * np.mean(sums <= w)))
    assert stats.wilcoxon_exact(df, ["g"], "d", most=0).collect()[0].p_exact is None


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(9)
    rows = [(g, int(rng.integers(0, 5)) if g == "t" else i, float(rng.normal())) for g in ("a", "t", None) for i in range(200)]
    df = spark.createDataFrame([(g, k, v, i) for i, (g, k, v) in enumerate(rows)], "g string, k long, v double, range_no long").repartition(5)
    got = order.running(df, ["g"], ["k", "range_no"], {"s": F.col("v"), "c": F.lit(1)}).collect()
    assert len(got) == 600
    for r in got:
        ahead = [v for i, (g, k, v) in enumerate(rows) if g == r.g and (k, i) < (r.k, r.range_no)]
        assert r.c == len(ahead) and r.s == pytest.approx(sum(ahead))
    placed = order.numbered(df, ["g"], ["k"], "pos").collect()
    assert {g: sorted(r.pos for r in placed if r.g == g) for g in ("a", "t", None)} == {g: list(range(200)) for g in ("a", "t", None)}
    q = {r.g: r.q for r in order.quantiles(df, ["g"], "v", [0.0, 0.37, 0.5, 1.0]).collect()}
    for g in ("a", "t", None):
        assert q[g] == pytest.approx(np.quantile([v for x, _, v in rows if x == g], [0.0, 0.37, 0.5, 1.0]).tolist())
    assert order.quantiles(df.limit(0), [], "v", [0.5]).first()["q"] is None
    auc = roc_auc(df.withColumn("y", (F.col("v") > 0).cast("int")), ["g"], "v", "y").collect()
    assert len(auc) == 3 and all(r.auc == 1.0 for r in auc)


def brute_triviality(x, label, widths, offsets):
    n, stats_ = len(x), []
    d = np.diff(x, axis=0, prepend=x[:1])
    for ch in range(x.shape[1]):
        for base in (np.abs(d[:, ch]), d[:, ch]):
            for k in widths:
                window = lambda f: np.array([f(base[max(0, i - k // 2) : i + k // 2 + 1]) for i in range(n)])  # noqa: B023, E731
                for u in (0, 1):
                    for c in (0, 1, 3):
                        if k and (u or c) or not (k or u or c):
                            s = np.round(base - (u * window(np.mean) + c * window(np.std) if k else 0), 9)
                            if s.std() > 1e-12:
                                stats_.append(np.array([(s < v).sum() + ((s == v).sum() + 1) / 2 for v in s]))
    p = label.sum()

    def most(y):
        auc = [(r[y == 1].sum() - p * (p + 1) / 2) / (p * (n - p)) for r in stats_]
        return max(max(a, 1 - a) for a in auc)

    return most(label), float(np.percentile([most(np.roll(label, o)) for o in offsets], 95))


def test_triviality_of_channels_and_short_series(spark, monkeypatch):
    monkeypatch.setattr(windows, "PART", 32)
    rng = np.random.default_rng(10)
    n, label = 120, np.zeros(120, int)
    label[[0, 1, 2, 50, 51, 119]] = 1
    x = rng.normal(size=(n, 2))
    x[50:52, 1] += 9
    rows = [("m", c, i, float(x[i, c]), int(label[i])) for i in range(n) for c in (0, 1)]
    rows += [("few", c, i, float(i % 7), int(i < 2)) for i in range(40) for c in (0, 1)] + [("all", 0, i, 1.0 * i * i, int(i > 1)) for i in range(20)] + [("flat", 0, i, 2.0, int(i < 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "series string, channel int, pos long, value double, label int").repartition(3)
    got = {r.series: r for r in windows.permutation_triviality(df, 20, (0, 8)).collect()}
    offsets = [1 + int(int(md5(0, "m", s)[:8], 16) / 2**32 * (n - 1)) for s in range(1, 21)]
    want = brute_triviality(x, label, (0, 8), offsets)
    assert (got["m"].observed, got["m"].limit) == pytest.approx(want, abs=1e-8) and got["m"].trivial == int(want[0] >= want[1])
    assert (got["few"].trivial, got["few"].observed) == (1, None) and got["all"].trivial == 1 and (got["flat"].trivial, got["flat"].observed) == (0, None)


def test_series_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(windows, "PART", 16)
    rows = [("s", i, float(i * i % 17), int(i in (30, 31))) for i in range(100)]
    df = spark.createDataFrame(rows, "series string, pos long, value double, label int").repartition(3)
    kept = windows.block_split(df).collect()
    role = {r.pos: r.role for r in kept}
    full = {r.pos: r.block for r in windows.blocks(df).collect()}
    assert full == {i: i // 10 for i in range(100)} and role[30] == role[31] == "test"
    for i, r in role.items():
        near = {role.get(j) for j in range(i - 3, i + 4)}
        assert r == "test" or "test" not in near and (r == "val" or "val" not in near)
    assert sorted(r.pos for r in windows.around_anomaly(df, 20).collect()) == list(range(20, 40))
    assert [r.pos for r in windows.positions(df.drop("pos").withColumn("t", F.col("value")), "series", "t").select("pos").orderBy("pos").collect()] == list(range(100))


def test_models_name_every_table(spark):
    assert set(models.DETECTORS) == {*protocol.LONG, *protocol.WIDE} and callable(det.nearest)
