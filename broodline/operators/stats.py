"""Grouped statistics as built-in aggregates (no model objects, no UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.nulls import join_null_safe, safe_div
from broodline.functions.skew import join_by_share
from broodline.session import stage


def ols_by_group(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Simple OLS ``y ~ x`` per group on complete rows: intercept, slope, n, mean y.

    With constant ``x`` (or one row) the slope is NULL, as R reports an aliased
    coefficient; the intercept is then the mean of ``y`` (what ``lm`` fits).
    """
    slope = F.regr_slope(F.col(y), F.col(x))
    return df.groupBy(*keys).agg(
        F.when(slope.isNotNull(), F.regr_intercept(F.col(y), F.col(x)))
         .otherwise(F.regr_avgy(F.col(y), F.col(x))).alias("intercept"),
        slope.alias("slope"),
        F.regr_count(F.col(y), F.col(x)).alias("n"))


def predict_by_group(df: DataFrame, fits: DataFrame, keys: Sequence[str], x: str,
                     out: str) -> DataFrame:
    """Attach ``intercept + slope * x`` (intercept only when the slope is NULL) to every
    row, including rows whose ``y`` is missing. Keys match NULL to NULL."""
    j = join_null_safe(df, fits.select(*keys, "intercept", "slope"), list(keys))
    pred = F.when(F.col("slope").isNotNull(), F.col("intercept") + F.col("slope") * F.col(x)) \
        .otherwise(F.col("intercept"))
    return j.withColumn(out, pred).drop("intercept", "slope")


def avg_rank(c: str, part: Sequence[str]) -> Column:
    """Rank with ties averaged (as R ``rank``), within ``part``."""
    w = Window.partitionBy(*part).orderBy(F.col(c))
    ties = Window.partitionBy(*part, c)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def pearson(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation, NULL when either variance is 0 or n < 2."""
    sxx, syy, sxy = F.regr_sxx(F.col(y), F.col(x)), F.regr_syy(F.col(y), F.col(x)), \
        F.regr_sxy(F.col(y), F.col(x))
    return F.when((sxx > 0) & (syy > 0), safe_div(sxy, F.sqrt(sxx * syy)))


def spearman_by_group(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per group on complete rows (Pearson on average ranks).

    The rank windows are partitioned by the group keys; callers use it on per-season
    tables, where a group holds at most one row per season.
    """
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = c.select(*keys, avg_rank(x, keys).alias("_rx"), avg_rank(y, keys).alias("_ry"))
    return r.groupBy(*keys).agg(pearson("_rx", "_ry").alias("spearman"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the rank of ``value`` within ``keys``, ties averaged, as column ``out``; the
    rank of an unknown value is NULL. Unknown keys are groups of their own.

    For groups of any size: the distinct values are counted, sorted over all tasks by (keys,
    value) and summed up within each partition's part of a group; the sums of a group's parts,
    one row for each partition, give the parts their first rank. A value's rank reaches its
    rows by ``join_by_share``, so neither a hot group nor a hot value meets in one task.
    """
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ordered = stage(counts.orderBy(*keys, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    ranked = join_null_safe(ordered.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))), parts, [*keys, "_part"], "inner")
    cell = F.struct(*keys, value)
    ranks = stage(ranked.select(cell.alias("_cell"), "_n", (F.col("_first") + F.col("_inside") + (F.col("_n") + 1) / 2.0).alias(out)))
    total = ranks.agg(F.sum("_n")).first()[0] or 0
    rows = df.withColumn("_cell", F.when(F.col(value).isNotNull(), cell))
    return join_by_share(rows, ranks, "_cell", "_n", total).drop("_cell")


def spearman_of_large_groups(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``spearman_by_group`` for groups of any size, with the number of complete rows ``n``."""
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    r = average_ranks(average_ranks(c, keys, x, "_rx"), keys, y, "_ry")
    return r.groupBy(*keys).agg(pearson("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def zscore(c: str, part: Sequence[str]) -> tuple[Column, Column, Column]:
    """(mean, sample sd, z) of ``c`` within ``part``; z is NULL when sd is NULL or 0."""
    w = Window.partitionBy(*part)
    m, s = F.avg(c).over(w), F.stddev_samp(c).over(w)
    return m, s, safe_div(F.col(c) - m, s)


def weighted_mean(x: str, w: str) -> Column:
    """Aggregate ``weighted.mean(x, w, na.rm = TRUE)``: NULL x dropped with its weight."""
    keep = F.col(x).isNotNull()
    return safe_div(F.sum(F.when(keep, F.col(x) * F.col(w))),
                    F.sum(F.when(keep, F.col(w))).cast("double"))
