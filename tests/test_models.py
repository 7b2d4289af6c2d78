"""Rounding, ranks over large groups and linear models against exact or brute-force versions."""

import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from broodline.functions.nulls import r_round
from broodline.operators import linear, stats


def exact(x, digits):
    if x is None or not math.isfinite(x) or abs(x) * 10.0 ** digits >= 2.0 ** 52:
        return x
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN))


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 6])
def test_rounding_equals_exact_decimals(spark, digits):
    r = random.Random(digits)
    values = [k / 20 * 10 ** -j for k in range(-60, 61) for j in range(4)]  # printed halves of all kinds
    values += [(2 * r.randint(-10 ** 6, 10 ** 6) + 1) / (2 * 10 ** digits) for _ in range(3000)]
    values += [np.nextafter(v, s) for v in values[-500:] for s in (-math.inf, math.inf)]
    values += [r.uniform(-1, 1) * 10 ** r.randint(-8, 17) for _ in range(2000)]
    values += [0.15, 0.25, 0.35, 0.05, 2.5, -0.5, 1e300, -1e16, math.inf, -math.inf, math.nan, None]
    values = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.y for r in df.select("i", r_round("x", digits).alias("y")).orderBy("i").collect()]
    assert [(x, y, exact(x, digits)) for x, y in zip(values, got) if not same(y, exact(x, digits))] == []


def test_rounding_follows_the_stored_number(spark):
    df = spark.createDataFrame([(0.15,), (0.25,), (0.35,), (0.45,), (0.55,), (0.65,)], "x double")
    assert [r.y for r in df.select(r_round("x", 1).alias("y")).collect()] == [0.1, 0.2, 0.3, 0.5, 0.6, 0.7]


def test_ranks_equal_the_window(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 0.0, 1.5, *[r.random()] * 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    got = stats.average_ranks(df, ["g"], "x", "rank")
    assert got.columns == ["g", "x", "i", "rank"]
    known = df.where("x is not null").withColumn("rank", stats.avg_rank("x", ["g"]))
    want = {row.i: row["rank"] for row in known.collect()}
    assert {row.i: row["rank"] for row in got.collect()} == {i: want.get(i) for _, _, i in rows}


def test_ranks_of_one_large_group_spread_over_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("one").alias("g"), (F.col("id") * 7919 % n / 3).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = stats.average_ranks(df, ["g"], "x", "rank").withColumn("p", F.spark_partition_id())
        tasks = out.groupBy("p").count().collect()
        spread = out.agg(F.sum("rank"), F.max("rank"), F.count_distinct("rank")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in tasks) < 0.3 * n
    assert tuple(spread) == (n * (n + 1) / 2, n, n)


def test_spearman_of_large_groups_equals_the_window_form(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(9)]), r.choice([None, *range(30)])) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    one = {row.g: row.spearman for row in stats.spearman_of_large_groups(df, ["g"], "x", "y").collect()}
    two = {row.g: row.spearman for row in stats.spearman_by_group(df, ["g"], "x", "y").collect()}
    assert one.keys() == two.keys() and all(abs(one[g] - two[g]) < 1e-12 for g in one)


def model_rows(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g, year, day, kind = r.choice(["a", "b", None]), 1990 + r.randint(0, 20), r.randint(90, 160), r.choice(["first", "second", "third", None])
        y = 3 + 0.01 * (year - 2000) - 0.03 * day + {"first": 0.0, "second": 1.0, "third": -2.0, None: 0.0}[kind] + r.gauss(0, 1)
        out.append((i, g, float(year) if r.random() > 0.05 else None, day, kind, y if r.random() > 0.05 else None))
    return out


def solve(rows, terms):
    """Least squares by numpy: estimates, errors, sigma, (X'X)^-1."""
    x = np.array([[1.0, *t] for t in terms(rows)])
    y = np.array([r[5] for r in rows])
    inverse = np.linalg.inv(x.T @ x)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    df = len(y) - x.shape[1]
    sigma = math.sqrt(((y - x @ b) ** 2).sum() / df)
    return b, sigma * np.sqrt(np.diag(inverse)), sigma, df, inverse


def test_models_equal_least_squares(spark):
    rows = model_rows(1, 600)
    df = spark.createDataFrame(rows, "i int, g string, year double, day int, kind string, y double")
    terms = ["year", "day", "kind"]
    fits = linear.fit(df, ["g"], "y", terms)
    found = {}
    for r in linear.coefficients(fits, ["g"], 4).collect():
        found.setdefault(r.g, {})[r.term] = r
    design = lambda rs: [(r[2], r[3], r[4] == "second", r[4] == "third") for r in rs]
    predicted = {r.i: r for r in linear.predict(df, fits, ["g"], terms, linear.design(df, terms)).collect()}
    for g in ("a", "b", None):
        mine = [r for r in rows if r[1] == g]
        full = [r for r in mine if r[2] is not None and r[4] is not None and r[5] is not None]
        b, errors, sigma, degrees, inverse = solve(full, design)
        names = ["(Intercept)", "year", "day", "kindsecond", "kindthird"]
        assert list(found[g]) == names
        for name, estimate, error in zip(names, b, errors):
            r = found[g][name]
            assert r.estimate == pytest.approx(estimate, rel=1e-7) and r.std_error == pytest.approx(error, rel=1e-7)
            assert r.t_value == pytest.approx(estimate / error, rel=1e-6) and (r.n, r.df_residual) == (len(full), degrees)
            assert r.sigma == pytest.approx(sigma, rel=1e-9)
        for r in mine:
            p = predicted[r[0]]
            if r[2] is None or r[4] is None:
                assert p.fit is None and p.fit_se is None and p.fit_low is None
                continue
            x = np.array([1.0, *design([r])[0]])
            error = sigma * math.sqrt(x @ inverse @ x)
            assert p.fit == pytest.approx(x @ b, rel=1e-8) and p.fit_se == pytest.approx(error, rel=1e-6)
            assert p.fit_high - p.fit == pytest.approx(linear.t_quantile(degrees) * error, rel=1e-6)


def test_aliased_terms_and_small_groups(spark):
    rows = [("c", 1.0 * k, 2.0 * k + 1, 5.0, 3.0 * k + (k % 2)) for k in range(6)] + [("one", 1.0, 2.0, 3.0, 7.0), ("none", None, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, k double, y double")
    fits = linear.fit(df, ["g"], "y", ["a", "b", "k"])
    out = {(r.g, r.term): r for r in linear.coefficients(fits, ["g"], 3).collect()}
    assert {g for g, _ in out} == {"c", "one"}
    assert [out["c", t].estimate is None for t in ("a", "b", "k")] == [False, True, True] and out["c", "a"].df_residual == 4
    slope = np.polyfit(range(6), [3.0 * k + (k % 2) for k in range(6)], 1)[0]
    assert out["c", "a"].estimate == pytest.approx(slope)
    assert out["one", "(Intercept)"].estimate == 7.0 and out["one", "(Intercept)"].std_error is None
    assert linear.fit(df.limit(0), ["g"], "y", ["a"]).count() == 0


def test_many_levels_are_an_error(spark):
    df = spark.range(300).selectExpr("'g' as g", "cast(id as string) as f", "cast(id as double) as y")
    with pytest.raises(ValueError, match="levels"):
        linear.fit(df, ["g"], "y", ["f"])


def test_t_quantiles():
    """Known values, and the far expansion where the exact rule ends."""
    assert linear.t_quantile(1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-12)
    assert linear.t_quantile(2) == pytest.approx(4.302652729696142, rel=1e-10)
    assert linear.t_quantile(10) == pytest.approx(2.2281388519649385, rel=1e-10)
    assert linear.t_quantile(120) == pytest.approx(1.9799304050824413, rel=1e-10)


def test_t_expansion_joins_the_exact_part(spark):
    df = spark.createDataFrame([(k,) for k in (0, 1, 199, 200, 201, 500, 10_000)], "k int")
    got = {r.k: r.t for r in df.select("k", linear.t_of(F.col("k")).alias("t")).collect()}
    assert got[0] is None
    assert all(got[k] == pytest.approx(linear.t_quantile(k), rel=1e-9) for k in got if k)
