"""Breeding records, partner fidelity and re-pairing rate.

Reference order of the record table: sorted by (PopID, season, FemaleID, lay date), NA
last, ties in order of first appearance (``row_ord`` of the first source row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.clean import (
    FEMALE_DROP_BREEDING, MALE_DROP_BREEDING, SPECIES, recode_experiment,
)
from broodline.functions.nulls import first_last_by, join_null_safe, not_in, safe_div

RECORD_COLS = ["PopID", "BreedingSeason", "LocationID", "FemaleID", "MaleID",
               "LayDate_observed", "ClutchType_calculated", "Experiment"]


def breeding_records(brood: DataFrame, species: str = SPECIES) -> DataFrame:
    """Distinct breeding records with an Experiment y/n flag.

    Keeps rows with either bird known, drops rows whose female ID is one of the sentinels
    ``0``,``1``,``1e+06`` or male ``0``,``1`` (NULL IDs are kept). ``row_ord`` is the
    first source row of each distinct record (aggregated, so duplicates collapse
    map-side).
    """
    f, m = F.col("FemaleID"), F.col("MaleID")
    b = brood.where((F.col("Species") == species) & (f.isNotNull() | m.isNotNull())
                    & not_in(f, FEMALE_DROP_BREEDING) & not_in(m, MALE_DROP_BREEDING))
    b = b.withColumn("Experiment", F.when(recode_experiment("ExperimentID").isNull(), "n")
                     .otherwise("y"))
    return b.groupBy(*RECORD_COLS).agg(F.min("row_ord").alias("row_ord"))


def partner_fidelity(records: DataFrame) -> DataFrame:
    """Per record: ``partner`` same/switched vs the female's previous record, ``num_yrs``.

    Within (PopID, FemaleID) in record order, a record is "same"/"switched" when both
    birds are known, the previous record's male is known and equal/different, and the
    previous record is from another season. Only the first record of a season can satisfy
    the last condition, and its previous record is the last record of the female's
    previous season. So records are reduced to one row per (pop, female, season) with
    first/last male (partial aggregation), lagged over seasons (at most one row per
    season per bird), and the result joined back to the first record. Records of an
    unknown female never get a partner status and have ``num_yrs`` 0. An unknown season
    sorts last, counts as one more season and never has a status; an unknown population
    is a group of its own.
    """
    order = ["LayDate_observed", "row_ord"]
    known = records.where(F.col("FemaleID").isNotNull())
    per_season = known.groupBy("PopID", "FemaleID", "BreedingSeason").agg(
        *first_last_by("MaleID", order, "_first_m", "_last_m"),
        F.min_by(F.col("row_ord"), F.struct(F.col("LayDate_observed").isNull(),
                                            "LayDate_observed", "row_ord")).alias("_first_ord"))
    w = Window.partitionBy("PopID", "FemaleID").orderBy(F.col("BreedingSeason").asc_nulls_last())
    wa = Window.partitionBy("PopID", "FemaleID")
    prev = F.lag("_last_m").over(w)
    first_m = F.when(F.col("BreedingSeason").isNotNull(), F.col("_first_m"))
    status = F.when(prev == first_m, "same").when(prev != first_m, "switched")
    per_season = per_season.select(
        "PopID", "FemaleID", "BreedingSeason", "_first_ord",
        status.alias("_status"), F.count(F.lit(1)).over(wa).cast("bigint").alias("num_yrs"))
    k = join_null_safe(known, per_season, ["PopID", "FemaleID", "BreedingSeason"], "inner").withColumn(
        "partner", F.when(F.col("row_ord") == F.col("_first_ord"), F.col("_status")))
    u = records.where(F.col("FemaleID").isNull()).withColumns(
        {"num_yrs": F.lit(0).cast("bigint"), "partner": F.lit(None).cast("string")})
    out = k.select(*RECORD_COLS, "row_ord", "num_yrs", "partner").unionByName(
        u.select(*RECORD_COLS, "row_ord", "num_yrs", "partner"))
    return out.withColumns({"ncharID_F": F.length("FemaleID"), "ncharID_M": F.length("MaleID")})


def repair_rate(fidelity: DataFrame) -> DataFrame:
    """Per (PopID, season), first clutches only: females re-paired with the same male,
    females with any partner status, and their ratio (NULL for 0/0). Only populations
    with at least one re-pairing are kept."""
    f = fidelity.where(F.col("ClutchType_calculated") == "first")
    per = f.groupBy("PopID", "BreedingSeason").agg(
        F.count_distinct(F.when(F.col("partner") == "same", F.col("FemaleID"))).alias("repairs"),
        F.count_distinct(F.when(F.col("partner").isNotNull(), F.col("FemaleID"))).alias("tot_pairs"))
    per = per.withColumn("repair_prop", safe_div(F.col("repairs").cast("double"), F.col("tot_pairs")))
    w = Window.partitionBy("PopID")
    return per.withColumn("_tot", F.sum("repairs").over(w)).where(F.col("_tot") > 0).drop("_tot")
