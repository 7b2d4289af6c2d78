"""Linear models with several terms by group, from mergeable cross products.

``lm(y ~ a + b + factor)`` for each group: co-moments of all columns are aggregated (partial
aggregation, so a hot group is reduced before the shuffle), and each group's small matrix is
solved in its row by sweeping the terms in their order. A term that the terms before it
determine is aliased: its coefficient is NULL and predictions leave it out, as ``lm`` does.

Factors have treatment contrasts against their first level in sort order. Rows with an unknown
response or term are left out of the fit; prediction gives such rows NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.functions.nulls import join_null_safe, safe_div

#: A column is aliased if less than this share of its sum of squares is left by those before.
TOLERANCE = 1e-10
MOST_LEVELS = 50  # of a factor; more are an error, since there is an aggregate for each pair of columns


def factor_levels(df: DataFrame, name: str) -> list[str]:
    """The known levels of a factor in sort order; at most ``MOST_LEVELS``."""
    found = [r[0] for r in df.where(F.col(name).isNotNull()).select(name).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"factor {name} has more than {MOST_LEVELS} levels")
    return sorted(found)


def design(df: DataFrame, terms: Sequence[str]) -> dict[str, Column]:
    """The columns of the model matrix by coefficient name: a text term is a factor, with one
    column ``<term><level>`` for each level but the first; any other term is a number."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, Column] = {}
    for t in terms:
        if isinstance(kinds[t], T.StringType):
            for level in factor_levels(df, t)[1:]:
                out[f"{t}{level}"] = (F.col(t) == F.lit(level)).cast("double")
        else:
            out[t] = F.col(t).cast("double")
    return out


def _swept(matrix: Column, pivots: Sequence[int], least: Column, width: int) -> Column:
    """(matrix, swept pivots) after sweeping the flat matrix on ``pivots`` in order, leaving out
    those whose diagonal is at most ``least[k]``."""
    cell = lambda m, i, j: F.get(m, i * width + j)

    def step(state: Column, k: Column) -> Column:
        m = state["m"]
        pivot = cell(m, k, k)

        def one(v: Column, at: Column) -> Column:
            i, j = F.floor(at / width).cast("int"), (at % width).cast("int")
            return (F.when((i == k) & (j == k), F.lit(1.0) / pivot).when(i == k, v / pivot)
                    .when(j == k, -v / pivot).otherwise(v - cell(m, i, k) * cell(m, k, j) / pivot))

        return F.when(pivot > F.get(least, k), F.struct(F.transform(m, one).alias("m"), F.concat(state["done"], F.array(k)).alias("done"))) \
            .otherwise(F.struct(m.alias("m"), state["done"].alias("done")))

    start = F.struct(matrix.alias("m"), F.array().cast("array<int>").alias("done"))
    return F.aggregate(F.array(*(F.lit(k) for k in pivots)), start, step) if pivots else start


def fit(df: DataFrame, keys: Sequence[str], y: str, terms: Sequence[str]) -> DataFrame:
    """One row for each group: ``n``, ``df_residual``, ``sigma``, and arrays over the model
    columns (``names``): ``coefficients`` (NULL where aliased), ``means``, ``inverse`` (flat, of the
    centred cross products), and ``intercept``. See ``coefficients`` and ``predict``."""
    columns = design(df, terms)
    names = [f"_x{i}" for i in range(len(columns))]
    rows = df.select(*keys, F.col(y).cast("double").alias("_y"), *(c.alias(n) for c, n in zip(columns.values(), names)))
    rows = rows.na.drop("any", subset=["_y", *names])
    every, p = [*names, "_y"], len(names)
    # co-moments keep their precision when partial sums are merged
    moments = {(i, j): F.covar_pop(every[i], every[j]) * F.count(F.lit(1)) for i in range(p + 1) for j in range(i, p + 1)}
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.avg(c) for c in every)).alias("_means"),
        F.array(*(moments[min(i, j), max(i, j)] for i in range(p + 1) for j in range(p + 1))).alias("_m"))
    width = p + 1
    size = F.transform(F.sequence(F.lit(0), F.lit(p)), lambda i: F.get("_m", i * width + i) + F.col("n") * F.pow(F.get("_means", i), 2))
    sums = sums.withColumn("_least", F.transform(size, lambda v: v * TOLERANCE))
    solved = sums.withColumn("_s", _swept(F.col("_m"), range(p), F.col("_least"), width))
    numbers = F.sequence(F.lit(0), F.lit(p - 1)) if p else F.array().cast("array<int>")
    done = F.col("_s.done")
    coefficients = F.transform(numbers, lambda k: F.when(F.array_contains(done, k), F.get("_s.m", k * width + p)))
    means = F.slice("_means", 1, p) if p else F.array().cast("array<double>")
    inverse = F.transform(F.sequence(F.lit(0), F.lit(p * p - 1)), lambda at: F.when(
        F.array_contains(done, F.floor(at / p).cast("int")) & F.array_contains(done, (at % p).cast("int")),
        F.get("_s.m", F.floor(at / p).cast("int") * width + at % p)).otherwise(0.0)) if p else F.array().cast("array<double>")
    rest = F.col("n") - 1 - F.size(done)
    out = solved.select(*keys, "n", rest.cast("bigint").alias("df_residual"),
                        F.when(rest > 0, F.sqrt(F.greatest(F.get("_s.m", F.lit(width * width - 1)), F.lit(0.0)) / rest)).alias("sigma"),
                        F.get("_means", F.lit(p)).alias("_mean_y"), coefficients.alias("coefficients"), means.alias("means"),
                        inverse.alias("inverse"))
    products = F.zip_with("coefficients", "means", lambda b, m: F.coalesce(b * m, F.lit(0.0)))
    return out.select(*keys, "n", "df_residual", "sigma", F.array(*map(F.lit, columns)).cast("array<string>").alias("names"),
                      (F.col("_mean_y") - F.aggregate(products, F.lit(0.0), add)).alias("intercept"), "coefficients", "means", "inverse")


def _spread(offsets: Column, p: int) -> Column:
    """x' inverse x for an array ``offsets`` of p numbers."""
    if not p:
        return F.lit(0.0)
    terms = F.transform("inverse", lambda v, at: v * F.get(offsets, F.floor(at / p).cast("int")) * F.get(offsets, (at % p).cast("int")))
    return F.aggregate(terms, F.lit(0.0), add)


def coefficients(fits: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Long form of ``fits`` with ``p`` model columns: (keys, term, estimate, std_error, t_value,
    n, df_residual, sigma); an aliased term has NULLs."""
    at_zero = F.sqrt(1 / F.col("n") + _spread(F.transform("means", lambda m: -m), p)) * F.col("sigma")
    first = F.struct(F.lit("(Intercept)").alias("term"), F.col("intercept").alias("estimate"), at_zero.alias("std_error"))
    others = F.transform("names", lambda name, i: F.struct(
        name.alias("term"), F.get("coefficients", i).alias("estimate"),
        F.when(F.get("coefficients", i).isNotNull(), F.sqrt(F.get("inverse", i * p + i)) * F.col("sigma")).alias("std_error")))
    rows = fits.select(*keys, "n", "df_residual", "sigma", F.explode(F.concat(F.array(first), others)).alias("c"))
    return rows.select(*keys, "c.term", "c.estimate", "c.std_error", safe_div("c.estimate", "c.std_error").alias("t_value"),
                       "n", "df_residual", "sigma")


def t_quantile(df: int, chance: float = 0.975) -> float:
    """The quantile of Student's distribution, by bisection on its distribution function for
    whole degrees of freedom (a finite sum in the angle atan(t / sqrt(df)))."""

    def below(t: float) -> float:
        angle = math.atan(t / math.sqrt(df))
        c, s = math.cos(angle), math.sin(angle)
        if df % 2:
            term, total = c, c if df > 1 else 0.0
            for k in range(3, df - 1, 2):
                term *= c * c * (k - 1) / k
                total += term
            inside = 2 / math.pi * (angle + s * total)
        else:
            term = total = 1.0
            for k in range(2, df - 1, 2):
                term *= c * c * (k - 1) / k
                total += term
            inside = s * total
        return 0.5 + inside / 2

    low, high = 0.0, 1.0
    while below(high) < chance:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < chance else (low, mid)
    return (low + high) / 2


EXACT_T = 200  # degrees of freedom up to which quantiles are exact


def t_of(df: Column) -> Column:
    """Aggregate-free quantile 0.975 of Student's distribution: exact up to ``EXACT_T`` degrees
    of freedom, the normal quantile's expansion beyond (error below 1e-9); NULL below 1."""
    z = 1.959963984540054
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    far = reduce(add, (F.lit(c) / F.pow(df, F.lit(i)) for i, c in enumerate(terms)))
    table = F.array(*(F.lit(t_quantile(k)) for k in range(1, EXACT_T + 1)))
    return F.when(df < 1, F.lit(None)).when(df <= EXACT_T, F.get(table, df.cast("int") - 1)).otherwise(far)


def predict(df: DataFrame, fits: DataFrame, keys: Sequence[str], terms: Sequence[str], columns: dict[str, Column],
            out: str = "fit") -> DataFrame:
    """``df`` with the prediction ``out``, its standard error ``out_se`` and the 95 % confidence
    band ``out_low`` and ``out_high``; unknown keys match unknown keys."""
    x = F.array(*columns.values()).cast("array<double>")
    rows = df.withColumn("_x", F.when(reduce(lambda a, b: a & b, (F.col(t).isNotNull() for t in terms), F.lit(True)), x))
    j = join_null_safe(rows, fits, list(keys))
    value = F.col("intercept") + F.aggregate(F.zip_with("coefficients", "_x", lambda b, v: F.coalesce(b, F.lit(0.0)) * v), F.lit(0.0), add)
    error = F.sqrt(1 / F.col("n") + _spread(F.zip_with("_x", "means", lambda v, m: v - m), len(columns))) * F.col("sigma")
    known = F.col("_x").isNotNull()
    j = j.withColumns({out: F.when(known, value), f"{out}_se": F.when(known, error)})
    half = t_of(F.col("df_residual")) * F.col(f"{out}_se")
    return j.select(*df.columns, out, f"{out}_se", (F.col(out) - half).alias(f"{out}_low"), (F.col(out) + half).alias(f"{out}_high"))
