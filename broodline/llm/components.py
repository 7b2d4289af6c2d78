"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodline.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links``(u, v) -> (id, comp) with comp the smallest id that id reaches.

    Least-label propagation with pointer jumping: each round takes the least label among
    the neighbours, then the label of that label, so a chain of length n ends in about
    log n rounds and a star in two. A hub meets its links in a join that AQE can split, and
    its labels in a partially aggregated minimum. Ids without links are not in the result.
    Null ends are ignored; no links give no rows.
    """
    links = links.where("u is not null and v is not null and u <> v")
    both = materialize(links.select("u", "v").union(links.select("v", "u").toDF("u", "v")).distinct())
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least("id", F.min("v")).alias("comp")))
    while True:
        near = (both.join(labels.withColumnRenamed("id", "v"), "v")
                .groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("near")))
        step = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        after = materialize(step.join(jump, "next", "left").select(
            "id", F.least("next", F.coalesce("far", "next")).alias("comp"), F.col("comp").alias("old")))
        if after.where("comp <> old").isEmpty():
            return after.select("id", "comp")
        labels = after.select("id", "comp")
