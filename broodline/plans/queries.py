"""Named queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the full adapter views (no id subsets or row caps) and composes
library operators. Double columns are rounded to 6 decimals at the very end so that
the engine-independent comparison is not decided by the last bit of a float sum.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.functions.nulls import r_round
from broodline.operators import breeding, captures, density, fledge, history, linear, ordered, overview, pairs, smooth, stats
from broodline.session import ensure_checkpoint_dir, materialize, stage
from broodline.sources.adapters import brood_view, capture_view, done_view, populations_view
from broodline.sources.rcsv import ROW_NAMES, read_csv_each, read_csv_r, write_csv_r

Query = Callable[[SparkSession, str], DataFrame]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


FINAL10 = ["pop", "nest", "year", "female", "f_pair_num", "male", "m_pair_num", "order",
           "no_order_f", "no_order_m"]
CLEAN_COLS = ["row_ord", "PopID", "BreedingSeason", "LocationID", "FemaleID", "MaleID",
              "Brood_exp", "LayDate_observed", "ClutchType_calculated", "Num_male_partners",
              "MaleID_known", "MaleID_recode", "Num_female_partners", "FemaleID_known",
              "FemaleID_recode"]


# ---------------------------------------------------------------- pairs (P1)
def _clean(spark, d):
    return stage(pairs.clean_pairs(pairs.pairing_brood(brood_view(spark, d)), stage))


def q_partner_multiplicity(spark, d):
    return pairs.partner_multiplicity(brood_view(spark, d))


def q_partner_crosstab(spark, d):
    return pairs.partner_crosstab(pairs.partner_multiplicity(brood_view(spark, d)))


def q_clean_pairs(spark, d):
    return _clean(spark, d).select(*CLEAN_COLS)


def q_ordered_multi_partner(spark, d):
    return pairs.ordered_multi_partner(_clean(spark, d)).select(*CLEAN_COLS)


def q_first_season_literal(spark, d):
    return pairs.first_season(_clean(spark, d), mode="literal")


def q_first_season_both(spark, d):
    ref = pairs.pairing_brood(brood_view(spark, d))
    return pairs.first_season(_clean(spark, d), ref, mode="both_sexes")


def q_capture_enrichment(spark, d):
    first = pairs.first_season(_clean(spark, d), mode="literal")
    return pairs.capture_enrichment(capture_view(spark, d), first)


def _ordered_pairs(spark, d, mode="literal"):
    return pairs.pairs_table(brood_view(spark, d), capture_view(spark, d), mode=mode)


def q_build_pairs(spark, d):
    return pairs.pairs_table(brood_view(spark, d), capture_view(spark, d), labels=True)


def q_experiment_summary(spark, d):
    return pairs.experiment_summary(_ordered_pairs(spark, d))


def final_pairs_tie(spark, d, mode="literal", cut=True):
    """The pair table (product P1); the reference writes it to disk here as well.
    ``cut=False`` for consumers that read it once."""
    fp = pairs.final_pairs(_ordered_pairs(spark, d, mode), keep_tie=True)
    return stage(fp) if cut else fp


def q_final_pairs(spark, d):
    return final_pairs_tie(spark, d, cut=False).select(*FINAL10)


def q_final_pairs_both_sexes(spark, d):
    return final_pairs_tie(spark, d, "both_sexes", cut=False).select(*FINAL10)


def q_drop_unorderable_males(spark, d):
    return pairs.drop_unorderable(final_pairs_tie(spark, d), "male").select(*FINAL10)


# ---------------------------------------------------------------- histories (P2, P3)
def _codes(spark, d, focal, require_known_partner=True):
    """(event codes, the pair rows they were built from)."""
    fp = final_pairs_tie(spark, d)
    if focal == "male":
        fp = stage(pairs.drop_unorderable(fp, "male"))  # the coder reads it four times
    return history.event_codes(fp, focal, require_known_partner), fp


def q_event_codes_female(spark, d):
    return _codes(spark, d, "female")[0]


def q_event_codes_male(spark, d):
    return _codes(spark, d, "male")[0]


def q_event_codes_male_any_partner(spark, d):
    """Code 6 without the known-partner clause (the rule the shipped male golden follows)."""
    return _codes(spark, d, "male", require_known_partner=False)[0]


def _wide(spark, d, focal):
    codes, fp = _codes(spark, d, focal)
    # the codes cover exactly the observed years of their pair rows: take the pivot
    # columns from that (staged) table instead of running the codes twice
    return history.wide_history(codes, focal, years=history.observed_years(fp))


def q_wide_history_female(spark, d):
    return _wide(spark, d, "female")


def q_wide_history_male(spark, d):
    return _wide(spark, d, "male")


def q_pair_diagnostics(spark, d):
    return history.pair_diagnostics(final_pairs_tie(spark, d))


# ---------------------------------------------------------------- records (P4, P5)
def _records(spark, d):
    """The breeding-record table (product P4, written to disk by the reference as well)."""
    return stage(breeding.breeding_records(brood_view(spark, d)))


def q_breeding_records(spark, d):
    return breeding.breeding_records(brood_view(spark, d))


def q_partner_fidelity(spark, d):
    return breeding.partner_fidelity(_records(spark, d))


def q_repair_rate(spark, d):
    return round_doubles(breeding.repair_rate(breeding.partner_fidelity(_records(spark, d))))


def q_capture_records(spark, d):
    return captures.capture_records(capture_view(spark, d))


# ---------------------------------------------------------------- fledge index (P6)
def _metrics(spark, d):
    # one row per (population, season): small at any scale, read several times downstream
    return materialize(fledge.fledge_metrics(fledge.fledge_input(brood_view(spark, d))))


def _adjusted(spark, d):
    return materialize(fledge.adjust_by_regression(_metrics(spark, d)))


def q_fledge_metrics(spark, d):
    return round_doubles(fledge.fledge_metrics(fledge.fledge_input(brood_view(spark, d))))


def q_fledge_metrics_ignore_na(spark, d):
    """``prop_second_clutch`` without the NA element R's subsetting adds."""
    return round_doubles(fledge.fledge_metrics(fledge.fledge_input(brood_view(spark, d)),
                                               literal_prop_second=False))


def q_fledge_adjusted(spark, d):
    return round_doubles(_adjusted(spark, d))


def q_fledge_line_by_group(spark, d):
    return round_doubles(fledge.fledge_line_by_group(_metrics(spark, d)))


def q_metric_agreement(spark, d):
    return round_doubles(fledge.metric_agreement(_adjusted(spark, d)))


def q_metric_agreement_overall(spark, d):
    return round_doubles(fledge.metric_agreement_overall(fledge.metric_agreement(_adjusted(spark, d))))


def q_fledge_standardised(spark, d):
    return round_doubles(fledge.standardise(_adjusted(spark, d)))


def q_fledge_change(spark, d):
    return round_doubles(fledge.standardised_change(fledge.standardise(_adjusted(spark, d))))


def q_fledge_change_skip_missing(spark, d):
    return round_doubles(fledge.standardised_change(fledge.standardise(_adjusted(spark, d)),
                                                    skip_missing=True))


def q_metric_long(spark, d):
    return round_doubles(fledge.metric_long(_adjusted(spark, d)))


def q_metric_diff_long(spark, d):
    return round_doubles(fledge.metric_diff_long(_adjusted(spark, d)))


def q_low_female_coverage(spark, d):
    return round_doubles(fledge.low_female_coverage(_adjusted(spark, d)))


def q_coverage_by_clutch(spark, d):
    return round_doubles(fledge.coverage_by_clutch(fledge.fledge_input(brood_view(spark, d))))


def q_nests_females_per_year(spark, d):
    return fledge.nests_females_per_year(fledge.fledge_input(brood_view(spark, d)))


# ---------------------------------------------------------------- overview (P8)
def _lookups(spark, d):
    b = brood_view(spark, d)
    return b, populations_view(b), done_view(fledge.fledge_input(b))


def q_population_overview(spark, d):
    b, pops, done = _lookups(spark, d)
    return overview.population_overview(b, pops, done)


def q_populations_missing(spark, d):
    _, pops, done = _lookups(spark, d)
    return overview.populations_missing(pops, done)


# ---------------------------------------------------------------- CSV side (sources and sinks)
def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_csv_breeding_records(spark, d):
    """``write.csv`` with row names, read back by ``read.csv`` with the columns in another
    order."""
    records, path = _records(spark, d), _scratch(spark, "records")
    write_csv_r(records, path, row_names_by=["PopID", "BreedingSeason", "FemaleID", "LayDate_observed", "row_ord"])
    fields = [T.StructField(ROW_NAMES, T.LongType()), *records.schema.fields]
    return read_csv_r(spark, path, T.StructType(fields[::-1]), "base").withColumnRenamed(ROW_NAMES, "row")


def q_csv_pair_table(spark, d):
    """``write_csv`` of the pair table with quotes and commas in a field, read back by
    ``read_csv``."""
    path = _scratch(spark, "pairs")
    table = final_pairs_tie(spark, d, cut=False).select(*FINAL10).withColumn(
        "nest", F.concat(F.lit('"'), F.col("nest"), F.lit('", "x""')))
    write_csv_r(table, path)
    return read_csv_r(spark, path, table.schema, "readr")


def remarks_view(spark: SparkSession, d: str) -> DataFrame:
    """One remark for each nest: missing, empty, the text NA, and fields with quotes, commas
    and line ends of both kinds, at their ends too."""
    k, lf = F.col("row_ord"), F.lit("\n")
    text = (F.when(k % 8 == 0, F.lit(None).cast("string")).when(k % 8 == 1, "").when(k % 8 == 2, "NA")
            .when(k % 8 == 3, F.concat(F.lit("ring lost"), lf, F.lit('"second" visit, box '), "LocationID"))
            .when(k % 8 == 4, F.concat(F.lit('"'), lf, lf, F.col("LocationID"), F.lit('",'), lf))
            .when(k % 8 == 5, F.concat(F.lit("\r\n"), "LocationID", F.lit("\r\n,")))
            .when(k % 8 == 6, F.concat(F.lit('""'), "LocationID")).otherwise(F.concat(F.lit("box "), "LocationID")))
    return brood_view(spark, d).select("row_ord", "PopID", text.alias("remark"))


def q_csv_remarks(spark, d):
    """``write_csv`` of free-text remarks with line ends inside fields, read back by both of
    R's readers."""
    path = _scratch(spark, "remarks")
    table = remarks_view(spark, d)
    write_csv_r(table, path)
    base, readr = (read_csv_r(spark, path, table.schema, f).select(F.lit(f).alias("reader"), "*") for f in ("base", "readr"))
    return base.unionByName(readr)


def q_csv_histories_female(spark, d):
    """Wide histories, one folder per population with its own years, read back in long form."""
    codes, path = stage(_codes(spark, d, "female")[0]), _scratch(spark, "histories")
    history.write_wide_per_population(codes, "female", path)
    keys = ("pop", "female", "multi_partner")
    rows = read_csv_each(spark, path, "readr").select(
        *(F.col("fields")[k].alias(k) for k in keys), F.explode(F.map_filter("fields", lambda k, v: ~k.isin(*keys))).alias("year", "event_code"))
    return rows.select("pop", "female", F.nullif("year", F.lit(history.NO_YEAR)).cast("int").alias("year"),
                       F.col("multi_partner").cast("int").alias("multi_partner"), "event_code")


# ---------------------------------------------------------------- rounding, ranks and models
def q_rounded_means(spark, d):
    """Mean fledglings by population, season and box, and their halves, rounded as R rounds."""
    mean = brood_view(spark, d).groupBy("PopID", "BreedingSeason", "LocationID").agg(
        F.avg(F.col("NumberFledged_observed").cast("double")).alias("mean"))
    return mean.select("PopID", "BreedingSeason", "LocationID", r_round("mean", 1).alias("one"), r_round("mean", 2).alias("two"),
                       r_round(F.col("mean") / 2, 2).alias("half"), r_round(F.col("mean") * 0.1, 2).alias("tenth"))


def _lay_days(spark, d):
    """The nests of the index with the day of the year of the first egg."""
    return fledge.lay_days(brood_view(spark, d))


def q_lay_day_rank_correlation(spark, d):
    """Spearman correlation of lay date and fledglings over all nests of a population."""
    return round_doubles(stats.spearman_of_large_groups(_lay_days(spark, d), ["PopID"], "lay_day", "fledged"))


def _fledge_model(spark, d):
    nests, terms = _lay_days(spark, d), ["lay_day", "BreedingSeason"]
    return nests, terms, stage(linear.fit(nests, ["PopID"], "fledged", terms))


def q_fledge_model(spark, d):
    """``lm(fledged ~ lay_day + BreedingSeason)`` by population."""
    _, terms, fits = _fledge_model(spark, d)
    return round_doubles(linear.coefficients(fits, ["PopID"], len(terms)))


def q_fledge_model_predictions(spark, d):
    """The model's prediction for each nest, with its standard error."""
    nests, terms, fits = _fledge_model(spark, d)
    return round_doubles(linear.predict(nests, fits, ["PopID"], terms, linear.design(nests, terms)).select(
        "row_ord", "fit", "fit_se"))


def q_fledge_by_clutch_type(spark, d):
    """``lm(fledged ~ clutch type)`` by population: a factor with treatment contrasts."""
    nests = _lay_days(spark, d)
    fits = stage(linear.fit(nests, ["PopID"], "fledged", ["ClutchType_calculated"]))
    return round_doubles(linear.coefficients(fits, ["PopID"], len(linear.design(nests, ["ClutchType_calculated"]))))


def q_fledge_trend_band(spark, d):
    """The chart's trend of fledge ratio on the share of second clutches with its 95 % band, at
    the seasons observed."""
    metrics = _metrics(spark, d)
    fits = stage(linear.fit(metrics, ["PopID"], "fledge_ratio", ["prop_second_clutch"]))
    band = linear.predict(metrics, fits, ["PopID"], ["prop_second_clutch"], linear.design(metrics, ["prop_second_clutch"]))
    return round_doubles(band.select("PopID", "BreedingSeason", "prop_second_clutch", "fit", "fit_low", "fit_high"))


def q_event_codes_by_season(spark, d):
    """Female event codes, season after season from the state, as the pair rows arrive."""
    pairs_ = final_pairs_tie(spark, d)
    state = history.Seasons.none(spark, "female")
    for year in history.observed_years(pairs_):  # the calendar's seasons, in the order they arrive
        state = state.add(pairs_.where(F.col("year").eqNullSafe(F.lit(year))))
    return state.event_codes()


def q_fledge_smooth(spark, d):
    """The charts' smooth curve with its band: fledglings per female on the number of females, by
    population."""
    fits = smooth.fit(_metrics(spark, d), ["PopID"], "females", "fledge_fem_avg")
    return round_doubles(smooth.curve(fits, ["PopID"]))


def q_lay_day_smooth(spark, d):
    """The smooth curve of fledglings on the lay date over all nests of a population."""
    fits = smooth.fit(_lay_days(spark, d), ["PopID"], "lay_day", "fledged")
    return round_doubles(smooth.curve(fits, ["PopID"]))


def q_lay_density(spark, d):
    """Density of the day of the first egg by population and clutch type."""
    return round_doubles(density.density_by_group(_lay_days(spark, d), ["PopID", "ClutchType_calculated"], "lay_day"), 9)


def q_previous_capture(spark, d):
    """The date and bird of the capture before in the same population: a lag within few, very
    large groups."""
    c = capture_view(spark, d).select("row_ord", "CapturePopID", F.struct("CaptureDate", "IndvID").alias("capture"), "CaptureDate")
    rows = ordered.lag_over_tasks(c, ["CapturePopID"], ["CaptureDate", "row_ord"], "capture", "before")
    return rows.select("row_ord", "CapturePopID", F.col("before.CaptureDate").alias("previous_date"), F.col("before.IndvID").alias("previous_bird"),
                       F.date_diff("CaptureDate", "before.CaptureDate").alias("days"))


def q_nearest_capture(spark, d):
    """The capture of the female that is nearest to the laying date of each of her nests."""
    nests = brood_view(spark, d).select("row_ord", F.upper("FemaleID").alias("bird"), F.col("LayDate_observed").alias("day"))
    captures_ = capture_view(spark, d).select(F.upper("IndvID").alias("bird"), F.col("CaptureDate").alias("day"))
    return ordered.nearest_in_time(nests, captures_, ["bird"], "day").withColumnRenamed("day", "lay_date")


QUERIES: dict[str, Query] = {
    "partner_multiplicity": q_partner_multiplicity,
    "partner_crosstab": q_partner_crosstab,
    "clean_pairs": q_clean_pairs,
    "ordered_multi_partner": q_ordered_multi_partner,
    "first_season_literal": q_first_season_literal,
    "first_season_both": q_first_season_both,
    "capture_enrichment": q_capture_enrichment,
    "build_pairs": q_build_pairs,
    "experiment_summary": q_experiment_summary,
    "final_pairs": q_final_pairs,
    "final_pairs_both_sexes": q_final_pairs_both_sexes,
    "drop_unorderable_males": q_drop_unorderable_males,
    "event_codes_female": q_event_codes_female,
    "event_codes_male": q_event_codes_male,
    "event_codes_male_any_partner": q_event_codes_male_any_partner,
    "wide_history_female": q_wide_history_female,
    "wide_history_male": q_wide_history_male,
    "pair_diagnostics": q_pair_diagnostics,
    "breeding_records": q_breeding_records,
    "partner_fidelity": q_partner_fidelity,
    "repair_rate": q_repair_rate,
    "capture_records": q_capture_records,
    "fledge_metrics": q_fledge_metrics,
    "fledge_metrics_ignore_na": q_fledge_metrics_ignore_na,
    "fledge_adjusted": q_fledge_adjusted,
    "fledge_line_by_group": q_fledge_line_by_group,
    "metric_agreement": q_metric_agreement,
    "metric_agreement_overall": q_metric_agreement_overall,
    "fledge_standardised": q_fledge_standardised,
    "fledge_change": q_fledge_change,
    "fledge_change_skip_missing": q_fledge_change_skip_missing,
    "metric_long": q_metric_long,
    "metric_diff_long": q_metric_diff_long,
    "low_female_coverage": q_low_female_coverage,
    "coverage_by_clutch": q_coverage_by_clutch,
    "nests_females_per_year": q_nests_females_per_year,
    "population_overview": q_population_overview,
    "populations_missing": q_populations_missing,
    "csv_breeding_records": q_csv_breeding_records,
    "csv_pair_table": q_csv_pair_table,
    "csv_histories_female": q_csv_histories_female,
    "csv_remarks": q_csv_remarks,
    "rounded_means": q_rounded_means,
    "lay_day_rank_correlation": q_lay_day_rank_correlation,
    "fledge_model": q_fledge_model,
    "fledge_model_predictions": q_fledge_model_predictions,
    "fledge_by_clutch_type": q_fledge_by_clutch_type,
    "fledge_trend_band": q_fledge_trend_band,
    "event_codes_by_season": q_event_codes_by_season,
    "fledge_smooth": q_fledge_smooth,
    "lay_day_smooth": q_lay_day_smooth,
    "lay_density": q_lay_density,
    "previous_capture": q_previous_capture,
    "nearest_capture": q_nearest_capture,
}
