"""The dip against a search over all modes and against a linear programme's bounds; its p on known shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.operators import modality


def minorant(x, y):
    """Greatest convex minorant at the points x, from all chords."""
    out = y.copy()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            inside = (x >= x[i]) & (x <= x[j])
            out[inside] = np.minimum(out[inside], y[i] + (y[j] - y[i]) * (x[inside] - x[i]) / (x[j] - x[i]))
    return out


def brute(values):
    x, c = np.unique(values, return_counts=True)
    hi = np.cumsum(c) / c.sum()
    lo = hi - c / c.sum()
    best = 1.0
    for m in range(len(x)):
        up = hi[: m + 1].copy()
        up[m] = lo[m]
        left = (up - minorant(x[: m + 1], lo[: m + 1])).max()
        down = lo[m:].copy()
        down[0] = hi[m]
        right = (-minorant(x[m:], -hi[m:]) - down).max()
        best = min(best, max(left, right))
    return max(best / 2, 0.5 / c.sum())


@pytest.mark.parametrize("seed", range(12))
def test_dip_equals_search_over_modes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 45))
    v = [rng.normal(size=n), rng.choice([0.0, 1.0, 5.0], n), np.concatenate([rng.normal(0, 1, n), rng.normal(6, 1, n)]), np.round(rng.normal(size=n), 1)][seed % 4]
    assert modality.dip(v) == pytest.approx(brute(v))


def test_known_values():
    assert modality.dip(np.arange(50.0)) == pytest.approx(0.01)  # evenly spaced: half a step
    assert modality.dip(np.repeat([0.0, 1.0], 50)) == pytest.approx(0.25)  # two points: a quarter


def test_p_of_shapes(spark):
    rng = np.random.default_rng(1)
    lists = {"one": rng.normal(size=300), "two": np.concatenate([rng.normal(0, 1, 150), rng.normal(5, 1, 150)]), "flat": rng.random(300)}
    df = spark.createDataFrame([(k, float(v)) for k, m in lists.items() for v in m], "what string, x double")
    got = {r.what: r for r in modality.dips(df, 200).collect()}
    assert got["two"].p == 0 and got["one"].p > 0.2 and 0.01 < got["flat"].p
    assert got["two"].dip == pytest.approx(modality.dip(lists["two"]))


def test_panel(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 1, (300, 4))
    m[:150, 0] += 7
    m[:, 3] = 2.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = modality.panel(df, simulations=100).collect()[0]
    assert got.dip_frac == pytest.approx(1 / 3) and got.bc_frac == pytest.approx(1 / 3) and got.bestdir_p < 0.05 and got.dip_proj_frac > 0.1
    assert modality.sarle(df.select(F.posexplode("v").alias("dim", "x"))).count() == 3
