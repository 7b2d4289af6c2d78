"""Fledging-success index per population and season.

The reference broadcasts every group quantity back to all nest rows and de-duplicates at
the end; here all quantities come from one GROUPING SETS aggregation (rows -> (pop, season,
female | nest | -)) and one (pop, season) aggregation, so the data shrinks to one row per
population-season after two shuffles. Everything after that works on that small table; its windows are
partitioned by population and hold one row per season.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.clean import (
    FEMALE_NO_TOTAL_FLEDGE, SPECIES, coalesce_versions, recode_experiment,
)
from broodline.functions.nulls import join_null_safe, n_distinct_na, r_round, safe_div
from broodline.operators.stats import ols_by_group, predict_by_group, spearman_by_group, \
    weighted_mean, zscore

PS = ["PopID", "BreedingSeason"]
VERSIONS = {
    "NumberFledged": ("NumberFledged_observed", "NumberFledged"),
    "ClutchSize": ("ClutchSize_observed", "ClutchSize"),
    "BroodSize": ("BroodSize_observed", "BroodSize"),
    "LayDate_observed": ("LayDate_observed", "LayDate"),
}
VERSION_TYPES = {"NumberFledged": "int", "ClutchSize": "int", "BroodSize": "int",
                 "LayDate_observed": "date"}


def fledge_input(brood: DataFrame, species: str = SPECIES) -> DataFrame:
    """Protocol versions merged, focal species, non-experimental nests only
    (``""``/``UNKNOWN`` experiment text counts as an experiment here)."""
    b = coalesce_versions(brood, VERSIONS, VERSION_TYPES)
    b = b.select("Species", "PopID", "BreedingSeason", "LocationID", "FemaleID", "MaleID",
                 "ClutchType_calculated", "LayDate_observed", "ClutchSize", "BroodSize",
                 "NumberFledged", recode_experiment("ExperimentID").alias("ExperimentID"))
    return b.where((F.col("Species") == species) & F.col("ExperimentID").isNull()) \
        .drop("ExperimentID")


def lay_days(brood: DataFrame, species: str = SPECIES) -> DataFrame:
    """The nests of the index with the day of the year of the first egg (1 to 366; NULL where the
    date is unknown) and the fledglings as a number."""
    b = coalesce_versions(brood, VERSIONS, VERSION_TYPES)
    b = b.where((F.col("Species") == species) & recode_experiment("ExperimentID").isNull())
    return b.select("row_ord", *PS, "ClutchType_calculated", F.dayofyear("LayDate_observed").alias("lay_day"),
                    F.col("NumberFledged").cast("double").alias("fledged"))


def fledge_metrics(inp: DataFrame, literal_prop_second: bool = True) -> DataFrame:
    """Per (PopID, season): clutches, clutch-type averages, female- and nest-based
    fledgling averages and their ratio; per population the mean ratio (2 dp).

    ``fledge_fem_avg`` / ``fledge_nest_avg`` are row-weighted means of per-female /
    per-nest totals (a unit with k rows counts k times; units whose total is NULL, and
    sentinel or unknown females, are skipped). ``prop_second_clutch`` = distinct locations
    of second clutches / clutches; with ``literal_prop_second`` (reference parity) the
    distinct count gains 1 when any row has an unknown clutch type or a second clutch has
    an unknown location (R subsetting by an NA condition yields an NA element, which
    ``n_distinct`` counts).

    One pass: ``GROUPING SETS`` computes the per-female, per-nest and per-season partial
    results in a single shuffle; every distinct count is then a count of non-null groups
    in the second, (pop, season)-level aggregation.
    """
    ct, nf, loc, fem = (F.col(c) for c in ("ClutchType_calculated", "NumberFledged",
                                            "LocationID", "FemaleID"))
    first, second = ct == "first", ct.isin("second", "replacement")
    lvl = inp.groupingSets(
        [PS + ["FemaleID"], PS + ["LocationID"], PS], *PS, "FemaleID", "LocationID").agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("_n"), F.sum(nf).alias("_tot"),
        F.sum(F.when(first, nf)).alias("_s1"), F.count(F.when(first, nf)).alias("_c1"),
        F.sum(F.when(second, nf)).alias("_s2"), F.count(F.when(second, nf)).alias("_c2"),
        F.max(ct == "second").alias("_has_second"),
        F.max(ct.isNull() | ((ct == "second") & loc.isNull())).alias("_na_elem"))
    # grouping_id bits (FemaleID, LocationID): 1 = female level, 2 = nest level, 3 = season
    g_f, g_l, g_s = (F.col("_gid") == 1), (F.col("_gid") == 2), (F.col("_gid") == 3)
    f_ok = g_f & F.col("_tot").isNotNull() & fem.isNotNull() & \
        ~fem.isin(list(FEMALE_NO_TOTAL_FLEDGE))
    l_ok = g_l & F.col("_tot").isNotNull()
    second_locs = F.count(F.when(g_l & loc.isNotNull() & F.col("_has_second"), 1))
    if literal_prop_second:
        second_locs = second_locs + F.max(F.when(g_s & F.col("_na_elem"), 1).otherwise(0))
    m = lvl.groupBy(*PS).agg(
        F.max(F.when(g_s, F.col("_n"))).alias("clutches"),
        second_locs.alias("_second_locs"),
        safe_div(F.max(F.when(g_s, F.col("_s1"))).cast("double"),
                 F.max(F.when(g_s, F.col("_c1")))).alias("_first"),
        safe_div(F.max(F.when(g_s, F.col("_s2"))).cast("double"),
                 F.max(F.when(g_s, F.col("_c2")))).alias("_second"),
        F.count(F.when(g_f & fem.isNotNull(), 1)).alias("females"),
        safe_div(F.sum(F.when(f_ok, F.col("_n") * F.col("_tot"))).cast("double"),
                 F.sum(F.when(f_ok, F.col("_n")))).alias("fledge_fem_avg"),
        F.count(F.when(g_l & loc.isNotNull(), 1)).alias("nests"),
        safe_div(F.sum(F.when(l_ok, F.col("_n") * F.col("_tot"))).cast("double"),
                 F.sum(F.when(l_ok, F.col("_n")))).alias("fledge_nest_avg"))
    m = m.select(
        *PS, "clutches",
        (F.col("_second_locs") / F.col("clutches")).alias("prop_second_clutch"),
        (F.coalesce("_first", F.lit(0.0)) + F.coalesce("_second", F.lit(0.0))).alias("avg_sum_clutch"),
        "females", "fledge_fem_avg", "nests", "fledge_nest_avg")
    m = m.withColumns({
        "fem_clutch_ratio": F.col("females") / F.col("clutches"),
        "fledge_ratio": safe_div("fledge_fem_avg", "fledge_nest_avg"),
    })
    return m.withColumn("fledge_ratio_avg",
                        r_round(F.avg("fledge_ratio").over(Window.partitionBy("PopID")), 2))


def adjust_by_regression(m: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Predicted fledge ratio from ``fledge_ratio ~ prop_second_clutch`` per population;
    populations with more than ``max_missing`` of their ratios missing share one pooled
    fit (``pooled`` TRUE). ``fledge_nest_avg_adj`` = nest average x prediction.
    A fit group without complete rows yields NULL predictions."""
    w = Window.partitionBy("PopID")
    m = m.withColumn("prop_NA", F.count_if(F.col("fledge_ratio").isNull()).over(w)
                     / F.count(F.lit(1)).over(w))
    m = m.withColumns({"pooled": F.col("prop_NA") > max_missing})
    m = m.withColumn("_fit_key", F.when(~F.col("pooled"), F.col("PopID")))
    fits = ols_by_group(m, ["_fit_key"], "fledge_ratio", "prop_second_clutch")
    m = predict_by_group(m, fits, ["_fit_key"], "prop_second_clutch", "fledge_ratio_pred")
    return m.drop("_fit_key").withColumn(
        "fledge_nest_avg_adj", F.col("fledge_nest_avg") * F.col("fledge_ratio_pred"))


def fledge_line_by_group(m: DataFrame) -> DataFrame:
    """Per population linear trend of fledge ratio on the share of second clutches."""
    return ols_by_group(m, ["PopID"], "fledge_ratio", "prop_second_clutch")


def metric_agreement(adj: DataFrame) -> DataFrame:
    """Per population: Spearman correlation (2 dp) of female- vs adjusted nest-based
    averages over seasons with both, and the number of such seasons (an unknown season
    counts as one)."""
    c = adj.where(F.col("fledge_fem_avg").isNotNull() & F.col("fledge_nest_avg_adj").isNotNull())
    cor = spearman_by_group(c, ["PopID"], "fledge_fem_avg", "fledge_nest_avg_adj")
    cnt = c.groupBy("PopID").agg(n_distinct_na("BreedingSeason").alias("count"))
    return join_null_safe(cnt, cor, ["PopID"]).select("PopID", r_round("spearman", 2).alias("cor"), "count")


def metric_agreement_overall(agreement: DataFrame) -> DataFrame:
    """Season-weighted mean correlation over populations (NULL correlations skipped)."""
    return agreement.agg(weighted_mean("cor", "count").alias("weighted_cor"))


def standardise(adj: DataFrame) -> DataFrame:
    """z-score of the adjusted per-nest average within each population (sample sd)."""
    s = adj.withColumnRenamed("fledge_nest_avg_adj", "pop_year_fledge_avg")
    mean, sd, z = zscore("pop_year_fledge_avg", ["PopID"])
    return s.select(*PS, "pop_year_fledge_avg", mean.alias("pop_tot_fledge_avg"),
                    sd.alias("pop_tot_fledge_sd"), z.alias("envStd_fledge_num"))


def standardised_change(std: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Absolute change of the standardised value vs the previous observed season of the
    population, then z-scored within the population.

    ``skip_missing`` drops incomplete seasons first (exploratory variant); otherwise a
    season with a missing value breaks the chain for the next season. An unknown season
    comes last.
    """
    if skip_missing:
        std = std.na.drop("any")
    w = Window.partitionBy("PopID").orderBy(F.col("BreedingSeason").asc_nulls_last())
    d = std.withColumn("_lag", F.abs(F.col("envStd_fledge_num")
                                     - F.lag("envStd_fledge_num").over(w)))
    _, _, z = zscore("_lag", ["PopID"])
    return d.select(*PS, "envStd_fledge_num", z.alias("Ztrans_envStd_fledge_num_lag"))


def metric_long(adj: DataFrame) -> DataFrame:
    """The three per-season averages in long form (``metric``, ``value``), NULLs kept."""
    return adj.select(*PS, "fledge_fem_avg", "fledge_nest_avg", "fledge_nest_avg_adj").unpivot(
        PS, ["fledge_fem_avg", "fledge_nest_avg", "fledge_nest_avg_adj"], "metric", "value")


def metric_diff_long(adj: DataFrame) -> DataFrame:
    """Raw and adjusted differences female- minus nest-based, long form, plus their
    difference ``diff_diff``."""
    d = adj.select(*PS, (F.col("fledge_fem_avg") - F.col("fledge_nest_avg")).alias("raw_diff"),
                   (F.col("fledge_fem_avg") - F.col("fledge_nest_avg_adj")).alias("adj_diff"))
    d = d.withColumn("diff_diff", F.col("adj_diff") - F.col("raw_diff"))
    return d.unpivot(PS + ["diff_diff"], ["raw_diff", "adj_diff"], "metric", "value")


def low_female_coverage(adj: DataFrame, max_ratio: float = 0.5) -> DataFrame:
    """Seasons with both averages where identified females cover under ``max_ratio`` of
    the clutches."""
    c = adj.where(F.col("fledge_fem_avg").isNotNull() & F.col("fledge_nest_avg_adj").isNotNull())
    return c.where(F.col("fem_clutch_ratio") < max_ratio).select(
        *PS, "fledge_nest_avg", "fledge_fem_avg", "fem_clutch_ratio")


def coverage_by_clutch(inp: DataFrame) -> DataFrame:
    """Rows, rows with an identified female and their share per (PopID, clutch type)."""
    g = inp.groupBy("PopID", "ClutchType_calculated").agg(
        F.count(F.lit(1)).alias("tot_obs"), F.count("FemaleID").alias("female_id"))
    return g.withColumn("perc_id", F.col("female_id") / F.col("tot_obs"))


def nests_females_per_year(inp: DataFrame) -> DataFrame:
    """Distinct nests and identified females per (PopID, season)."""
    return inp.groupBy(*PS).agg(F.count_distinct("LocationID").alias("nests"),
                                F.count_distinct("FemaleID").alias("fems"))
