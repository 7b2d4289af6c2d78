"""Kernel densities by group on a grid, as a ridge plot draws them.

Values are counted in bins, which merge over tasks; a group's density at each grid point is the
sum of a Gaussian kernel over its bins. With whole numbers (days of the year) and bins of 1
nothing is lost. The bandwidth is the rule of thumb ``bw.nrd0``, and the grid reaches three
bandwidths beyond the group's values, as ``density`` does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTS = 512
CUT = 3.0  # bandwidths beyond the values
MOST_BINS = 100_000  # of a group; more are an error, since a group's bins are one row


def density_by_group(df: DataFrame, keys: Sequence[str], value: str, width: float = 1.0, points: int = POINTS) -> DataFrame:
    """(keys, n, bandwidth, x, density) for each group with two or more known values.

    ``width``: bins are whole multiples of it. Unknown values are left out; unknown keys are
    groups of their own. Equal values everywhere give the bandwidth ``bw.nrd0`` falls back to:
    the size of the value, or 1.
    """
    bins = df.where(F.col(value).isNotNull()).select(*keys, (F.round(F.col(value) / width) * width).alias("_v")) \
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    total, v = F.sum("_n"), F.col("_v")
    groups = bins.groupBy(*keys).agg(
        total.alias("n"), F.collect_list(F.struct("_v", "_n")).alias("_bins"), F.min(v).alias("_low"), F.max(v).alias("_high"),
        (F.sum(v * F.col("_n")) / total).alias("_mean"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)), F.col("_n")).alias("_q"))
    too_many = F.raise_error(F.lit(f"a group has more than {MOST_BINS} bins; take wider ones"))
    groups = groups.where(F.when(F.size("_bins") > MOST_BINS, too_many.cast("boolean")).otherwise(F.col("n") > 1))
    squares = F.aggregate("_bins", F.lit(0.0), lambda a, b: a + b["_n"] * F.pow(b["_v"] - F.col("_mean"), 2))
    groups = groups.withColumn("_sd", F.sqrt(squares / (F.col("n") - 1)))
    spread = F.least("_sd", (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))) / 1.34)
    first = F.abs(F.col("_low"))
    spread = F.when(spread > 0, spread).when(F.col("_sd") > 0, F.col("_sd")).when(first > 0, first).otherwise(1.0)
    groups = groups.withColumn("bandwidth", 0.9 * spread * F.pow(F.col("n"), -0.2))
    start, end = F.col("_low") - CUT * F.col("bandwidth"), F.col("_high") + CUT * F.col("bandwidth")
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")) \
        .withColumn("x", start + (end - start) * F.col("_i") / (points - 1))
    kernel = F.aggregate("_bins", F.lit(0.0), lambda a, b: a + b["_n"] * F.exp(
        -0.5 * F.pow((F.col("x") - b["_v"]) / F.col("bandwidth"), 2)))
    return grid.select(*keys, "n", "bandwidth", "x", (kernel / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"))
