"""Parquet table access for the driver-generated tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; callers ``select`` what they need so the scan is pruned."""
    return spark.read.parquet(table_path(sf_dir, name))


def with_row_ord(df: DataFrame, name: str = "row_ord") -> DataFrame:
    """Add the input-order column the order-sensitive operators need.

    Apply it directly on a fresh scan (before any shuffle): ids then follow the order of
    the scan's file splits and rows, which is deterministic, so a recomputation after an
    executor loss yields the same ids. For a single file that is file order; with several
    files Spark orders splits by size, so give files a sortable key column instead when
    cross-file order matters.
    """
    from pyspark.sql import functions as F
    return df.withColumn(name, F.monotonically_increasing_id())
