"""Penalised splines by group against the same model solved by numpy."""

import math
import random

import numpy as np
import pytest

from broodline.operators import smooth


def design(u, basis):
    """B-splines from the recursion over evenly spaced knots, at ``u`` from 0 to basis - 3."""
    knots = np.arange(-3, basis + 1, dtype=float)
    b = np.array([(knots[i] <= u) & (u < knots[i + 1]) for i in range(len(knots) - 1)], float)
    b[:, u == basis - 3] = 0
    b[basis - 1, u == basis - 3] = 1  # the right end belongs to the last interval
    for d in range(1, 4):
        b = np.array([(u - knots[i]) / d * b[i] + (knots[i + d + 1] - u) / d * b[i + 1] for i in range(len(b) - 1)])
    return b[:basis].T


def brute(x, y, basis=smooth.BASIS):
    x, y = np.array(x, float), np.array(y, float)
    low, high, mean = x.min(), x.max(), y.mean()
    b = design((x - low) / (high - low) * (basis - 3), basis)
    d = np.diff(np.eye(basis), 2, axis=0)
    bb, unit = b.T @ b, (b ** 2).sum() / (d ** 2).sum()
    best = None
    for weight in smooth.WEIGHTS:
        inverse = np.linalg.inv(bb + weight * unit * d.T @ d)
        c = inverse @ b.T @ (y - mean)
        edf, rss = np.trace(inverse @ bb), ((y - mean - b @ c) ** 2).sum()
        if len(y) > edf and (best is None or len(y) * rss / (len(y) - edf) ** 2 < best[0] * (1 - 1e-9)):
            best = (len(y) * rss / (len(y) - edf) ** 2, weight, edf, c, inverse, math.sqrt(rss / (len(y) - edf)))
    _, weight, edf, c, inverse, sigma = best
    g = design(np.linspace(0, 1, smooth.POINTS) * (basis - 3), basis)
    return weight, edf, mean + g @ c, sigma * np.sqrt(np.einsum("ij,jk,ik->i", g, inverse, g))


def test_equals_the_dense_solution(spark):
    r = random.Random(4)
    groups = {"wave": [(v := r.uniform(0, 10), math.sin(v) + r.gauss(0, 0.2)) for _ in range(400)],
              "line": [(v := r.uniform(5, 6), 2 * v + r.gauss(0, 0.5)) for _ in range(60)],
              None: [(v := float(r.randint(90, 160)), (v - 120) ** 2 / 400 + r.gauss(0, 1)) for _ in range(300)]}
    rows = [(g, *p) for g, ps in groups.items() for p in ps]
    rows += [("one", 1.0, 2.0), ("one", 1.0, 3.0), ("wave", None, 1.0), ("wave", 1.0, None), ("unknown", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    fits = smooth.fit(df, ["g"], "x", "y")
    found = {row.g: row for row in fits.collect()}
    assert found.keys() == groups.keys()
    lines = {}
    for row in smooth.curve(fits, ["g"]).orderBy("x").collect():
        lines.setdefault(row.g, []).append(row)
    for g, points in groups.items():
        weight, edf, fit, error = brute(*zip(*points))
        assert found[g].weight == pytest.approx(weight) and found[g].edf == pytest.approx(edf, rel=1e-6) and found[g].n == len(points)
        assert [row.fit for row in lines[g]] == pytest.approx(fit, rel=1e-6, abs=1e-8)
        assert [row.fit_se for row in lines[g]] == pytest.approx(error, rel=1e-5)
        assert all(row.fit_low < row.fit < row.fit_high for row in lines[g])
    assert found["wave"].edf > 5 > 2.5 > found["line"].edf


def test_without_keys_and_empty(spark):
    df = spark.range(50).selectExpr("cast(id as double) as x", "cast(id % 7 as double) as y")
    assert smooth.curve(smooth.fit(df, [], "x", "y"), []).count() == smooth.POINTS
    assert smooth.fit(df.limit(0), [], "x", "y").count() == 0
