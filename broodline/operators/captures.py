"""Capture records extract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodline.functions.clean import SPECIES


def capture_records(capture: DataFrame, species: str = SPECIES) -> DataFrame:
    """One row per (IndvID, season) *across populations*: the first capture in input
    order, ``Experiment`` "y" when any capture of that bird and season has an
    ExperimentID (no placeholder recoding here), rows with any NULL dropped.

    A single aggregation: hot (bird, season) keys are reduced map-side.
    """
    c = capture.where(F.col("Species") == species)
    per = c.groupBy("BreedingSeason", "IndvID").agg(
        F.min_by(F.struct("CapturePopID", "Age_calculated"), F.col("row_ord")).alias("_f"),
        F.max(F.col("ExperimentID").isNotNull()).alias("_e"))
    out = per.select(
        F.col("_f.CapturePopID").alias("CapturePopID"), "IndvID", "BreedingSeason",
        F.col("_f.Age_calculated").alias("Age_calculated"),
        F.when(F.col("_e"), "y").otherwise("n").alias("Experiment"))
    return out.na.drop("any")
