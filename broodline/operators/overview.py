"""Population overview: pairs and years per population, processed or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def population_overview(brood: DataFrame, populations: DataFrame, done: DataFrame) -> DataFrame:
    """Per PopID with both birds known (raw IDs, any species): distinct pairs, season span
    ``max + 1 - min`` (NULL when a season is unknown), and ``done`` = "yes" when the
    population is in ``done``, the processed table. An unknown population is a group of its
    own, which the lookup does not have."""
    b = brood.where(F.col("MaleID").isNotNull() & F.col("FemaleID").isNotNull())
    summ = b.groupBy("PopID").agg(
        F.count_distinct("MaleID", "FemaleID").alias("num_pairs"),
        F.when(F.count("BreedingSeason") == F.count(F.lit(1)),
               F.max("BreedingSeason") + 1 - F.min("BreedingSeason")).cast("int").alias("num_years"))
    flag = done.select("PopID").distinct().withColumn("done", F.lit("yes"))
    pro = populations.select(F.col("pop_code").alias("PopID")).join(flag, "PopID", "left")
    return summ.join(pro, "PopID", "left")


def populations_missing(populations: DataFrame, done: DataFrame) -> DataFrame:
    """Population codes of the lookup that are not processed yet."""
    return populations.join(done, populations.pop_code == done.PopID, "left_anti") \
        .select("pop_code")
