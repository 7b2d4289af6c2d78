"""Penalised spline smoothers by group, from mergeable cross products.

The curve is a cubic B-spline on evenly spaced knots over a group's range, its second
differences penalised, the weight of the penalty chosen by generalised cross-validation. A row
touches four basis functions, so its products are summed by (group, interval) with partial
aggregation; a group's matrix is put together from its intervals and solved in one row for each
candidate weight. Fit and 95 % band come on a grid over the range, as a chart draws them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodline.functions.skew import join_by_share
from broodline.operators.linear import _swept
from broodline.session import stage

BASIS = 10  # functions, as the chart's smoother takes by default
POINTS = 80
WEIGHTS = [10.0 ** (k / 2) for k in range(-8, 13)]  # of the penalty, relative to the data's
BAND = 1.959963984540054


def _basis(u: Column, intervals: int) -> tuple[Column, list[Column]]:
    """The interval of ``u`` (0 to ``intervals``) and the four functions that are not 0 there."""
    j = F.least(F.floor(u), F.lit(intervals - 1)).cast("int")
    t = u - j
    return j, [F.pow(1 - t, 3) / 6, (3 * F.pow(t, 3) - 6 * F.pow(t, 2) + 4) / 6,
               (-3 * F.pow(t, 3) + 3 * F.pow(t, 2) + 3 * t + 1) / 6, F.pow(t, 3) / 6]


def _penalty(k: int) -> list[list[float]]:
    """Cross products of the second differences of ``k`` coefficients."""
    out = [[0.0] * k for _ in range(k)]
    for i in range(k - 2):
        for a, x in ((i, 1.0), (i + 1, -2.0), (i + 2, 1.0)):
            for b, y in ((i, 1.0), (i + 1, -2.0), (i + 2, 1.0)):
                out[a][b] += x * y
    return out


def fit(df: DataFrame, keys: Sequence[str], x: str, y: str, basis: int = BASIS) -> DataFrame:
    """One row for each group of known (x, y) with two or more different x: its ``n``, range
    (``low``, ``high``), ``weight``, ``edf``, ``sigma``, ``mean`` and arrays ``b`` and ``inverse``."""
    intervals, width = basis - 3, basis + 1
    cell = F.struct(*keys) if keys else F.struct(F.lit(0))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        cell.alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    groups = stage(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"),
                                          F.avg("_y").alias("mean")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    wide = groups.where("high > low")
    at = join_by_share(rows, wide.select("_k", "n", "low", "high", "mean"), "_k", "n", total).where("low is not null")
    j, w = _basis((F.col("_x") - F.col("low")) / (F.col("high") - F.col("low")) * intervals, intervals)
    at = at.select("_k", j.alias("j"), (F.col("_y") - F.col("mean")).alias("_y"), *(c.alias(f"_w{i}") for i, c in enumerate(w)))
    products = [F.sum(F.col(f"_w{a}") * F.col(f"_w{b}")) for a in range(4) for b in range(4)]
    parts = at.groupBy("_k", "j").agg(F.array(*products).alias("bb"), F.array(*(F.sum(F.col(f"_w{a}") * F.col("_y")) for a in range(4))).alias("by"),
                                      F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    # at most one row for each interval
    whole = parts.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("j", "bb", "by", "yy"))).alias("p"))

    def entry(i: int, k: int) -> Column:
        """The cross product of columns i and k, the response being the last."""
        if i == basis and k == basis:
            return F.aggregate("p", F.lit(0.0), lambda a, v: a + v["yy"])
        if basis in (i, k):
            i = min(i, k)
            return F.aggregate("p", F.lit(0.0), lambda a, v: a + F.when(
                (i - v["j"] >= 0) & (i - v["j"] < 4), F.get(v["by"], i - v["j"])).otherwise(0.0))
        if abs(i - k) > 3:
            return F.lit(0.0)
        low, high = min(i, k), max(i, k)
        return F.aggregate("p", F.lit(0.0), lambda a, v: a + F.when(
            (low - v["j"] >= 0) & (high - v["j"] < 4), F.get(v["bb"], (low - v["j"]) * 4 + high - v["j"])).otherwise(0.0))

    whole = whole.select("_k", F.array(*(entry(i, k) for i in range(width) for k in range(width))).alias("m"))
    penalty = _penalty(basis)
    flat = F.array(*(F.lit(penalty[i][k] if max(i, k) < basis else 0.0) for i in range(width) for k in range(width)))
    trace = reduce(add, (F.get("m", F.lit(i * width + i)) for i in range(basis))) / sum(penalty[i][i] for i in range(basis))
    tried = stage(whole).select("_k", "m", trace.alias("_unit"), F.explode(F.array(*map(F.lit, WEIGHTS))).alias("weight"))
    tried = tried.join(wide, "_k").withColumn(
        "_a", F.zip_with("m", flat, lambda v, p: v + p * F.col("weight") * F.col("_unit")))
    solved = tried.withColumn("_s", _swept(F.col("_a"), range(basis), F.array(*[F.lit(0.0)] * width), width)["m"])
    square = range(basis * basis)
    place = [(at // basis) * width + at % basis for at in square]
    solved = solved.withColumns({
        "inverse": F.array(*(F.get("_s", F.lit(i)) for i in place)),
        "b": F.array(*(F.get("_s", F.lit(i * width + basis)) for i in range(basis))),
        "_bb": F.array(*(F.get("m", F.lit(i)) for i in place))})
    edf = F.aggregate(F.zip_with("inverse", "_bb", lambda a, b: a * b), F.lit(0.0), add)
    by = F.aggregate(F.transform("b", lambda v, i: v * F.get("m", i * width + basis)), F.lit(0.0), add)
    bbb = F.aggregate(F.transform("_bb", lambda v, i: v * F.get("b", F.floor(i / basis).cast("int")) * F.get("b", (i % basis).cast("int"))), F.lit(0.0), add)
    rss = F.greatest(F.get("m", F.lit(width * width - 1)) - 2 * by + bbb, F.lit(0.0))
    solved = solved.withColumns({"edf": edf, "_rss": rss}).where("n > edf")
    solved = solved.withColumn("_gcv", F.col("n") * F.col("_rss") / F.pow(F.col("n") - F.col("edf"), 2))
    best = solved.groupBy("_k").agg(F.min_by(F.struct(
        "n", "low", "high", "weight", "edf", F.sqrt(F.col("_rss") / (F.col("n") - F.col("edf"))).alias("sigma"), "mean", "b", "inverse"),
        F.struct("_gcv", -F.col("weight"))).alias("f"))
    return best.select(*(F.col("_k")[k].alias(k) for k in keys), "f.*")


def curve(fits: DataFrame, keys: Sequence[str], points: int = POINTS, basis: int = BASIS) -> DataFrame:
    """(keys, n, edf, x, fit, fit_se, fit_low, fit_high) on an even grid over each group's range."""
    grid = fits.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")).withColumn("_t", F.col("_i") / (points - 1))
    j, w = _basis(F.col("_t") * (basis - 3), basis - 3)
    grid = grid.withColumn("_j", j).withColumn("_w", F.array(*w))
    value = reduce(add, (F.get("_w", F.lit(a)) * F.get("b", F.col("_j") + a) for a in range(4)))
    spread = reduce(add, (F.get("_w", F.lit(a)) * F.get("_w", F.lit(c)) * F.get("inverse", (F.col("_j") + a) * basis + F.col("_j") + c)
                          for a in range(4) for c in range(4)))
    out = grid.select(*keys, "n", "edf", (F.col("low") + (F.col("high") - F.col("low")) * F.col("_t")).alias("x"),
                      (F.col("mean") + value).alias("fit"), (F.sqrt(F.greatest(spread, F.lit(0.0))) * F.col("sigma")).alias("fit_se"))
    half = BAND * F.col("fit_se")
    return out.select("*", (F.col("fit") - half).alias("fit_low"), (F.col("fit") + half).alias("fit_high"))
