"""Kernel densities by group against plain numpy."""

import random

import numpy as np
import pytest

from broodline.operators import density


def brute(values, points):
    v = np.array(values, float)
    sd, q = v.std(ddof=1), np.quantile(v, [0.25, 0.75])
    spread = min(sd, (q[1] - q[0]) / 1.34) or sd or abs(v.min()) or 1.0
    h = 0.9 * spread * len(v) ** -0.2
    x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, points)
    y = np.exp(-0.5 * ((x[:, None] - v[None, :]) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    return h, x, y


def test_equals_brute_force(spark):
    r = random.Random(2)
    groups = {"a": [r.randint(90, 160) for _ in range(300)], None: [r.randint(1, 366) for _ in range(40)], "two": [100, 140],
              "same": [120] * 5, "zero": [0, 0, 0], "quartiles": [5, 5, 5, 5, 5, 5, 5, 9]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", 7), ("unknown", None), ("a", None)]
    got = {}
    for row in density.density_by_group(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", points=64).orderBy("x").collect():
        got.setdefault(row.g, []).append(row)
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        h, x, y = brute(values, 64)
        assert got[g][0].n == len(values) and got[g][0].bandwidth == pytest.approx(h)
        assert [r.x for r in got[g]] == pytest.approx(x) and [r.density for r in got[g]] == pytest.approx(y, rel=1e-9, abs=1e-12)


def test_a_density_integrates_to_one_and_bins_are_an_approximation(spark):
    r = random.Random(3)
    rows = [(r.gauss(100, 12),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "v double")
    out = density.density_by_group(df, [], "v", width=0.5).orderBy("x").collect()
    step = out[1].x - out[0].x
    assert sum(r.density for r in out) * step == pytest.approx(1, abs=0.005)
    _, _, y = brute([v for v, in rows], 512)
    assert np.abs(np.array([r.density for r in out]) - y).max() < 0.001


def test_too_many_bins_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(density, "MOST_BINS", 10)
    with pytest.raises(Exception, match="bins"):
        density.density_by_group(spark.range(50).selectExpr("1 as g", "cast(id as double) as v"), ["g"], "v").collect()
