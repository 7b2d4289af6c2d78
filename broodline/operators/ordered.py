"""Order within a key, over tasks: lags, carried values and joins to the nearest time.

A window function holds each key's rows in one task. Here the rows are sorted over all tasks
by (key, order), so a hot key is cut into slices; the window runs inside the slices, and each
slice's last row (or last known value) is handed to the key's next slice. Those boundary rows
are one for each slice, a table as small as the number of partitions and keys.

Rows must be unique by (key, order), or be interchangeable where they are not. Unknown keys
are a key of their own; unknown order values sort last, as R sorts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.nulls import asc_nl, join_null_safe, order_struct
from broodline.session import stage

SLICE = "_slice"


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``df`` as a stored table with the number of its slice of the global order."""
    return stage(df.orderBy(*asc_nl(*keys, *order)).withColumn(SLICE, F.spark_partition_id()))


def _windows(keys: Sequence[str], order: Sequence):
    inside = Window.partitionBy(*keys, SLICE).orderBy(*asc_nl(*order))
    slices = Window.partitionBy(*keys).orderBy(SLICE)
    return inside, slices


def lag_over_tasks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with ``value`` of the row before within ``keys`` by ``order`` as ``out``; NULL on a
    key's first row. Equal to ``lag(value) over (partition by keys order by order)``."""
    rows, (inside, slices) = _sliced(df, keys, order), _windows(keys, order)
    rows = rows.withColumns({"_before": F.lag(value).over(inside), "_at": F.row_number().over(inside)})
    ends = rows.groupBy(*keys, SLICE).agg(F.max_by(F.struct(F.col(value).alias("v")), "_at").alias("_end"))
    ends = ends.select(*keys, SLICE, F.lag("_end").over(slices)["v"].alias("_handed"))
    joined = join_null_safe(rows, ends, [*keys, SLICE])
    return joined.select(*df.columns, F.when(F.col("_at") == 1, F.col("_handed")).otherwise(F.col("_before")).alias(out))


def carry_over_tasks(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str) -> DataFrame:
    """``df`` with the last known ``value`` at or before the row within ``keys`` as ``out``."""
    rows, (inside, slices) = _sliced(df, keys, order), _windows(keys, order)
    known = F.last(value, ignorenulls=True)
    rows = rows.withColumn("_here", known.over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*keys, SLICE).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), order_struct(order))).alias("_end"))
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, SLICE, F.last("_end", ignorenulls=True).over(earlier).alias("_handed"))
    joined = join_null_safe(rows, ends, [*keys, SLICE])
    return joined.select(*df.columns, F.coalesce("_here", "_handed").alias(out))


def _nearest_one_way(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Column, event: Column, out: str) -> DataFrame:
    """``left`` with the ``right`` row that comes last at or before it by the ascending ``at``."""
    both = left.withColumns({"_at": at, "_side": F.lit(1)}).unionByName(
        right.select(*keys, at.alias("_at"), F.lit(0).alias("_side"), event.alias("_event")), allowMissingColumns=True)
    # at the same time the event comes first
    carried = carry_over_tasks(both, keys, ["_at", "_side"], "_event", out)
    return carried.where("_side = 1").select(*left.columns, out)


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """``left`` with ``nearest``, the time of the ``right`` row of the same key whose ``time`` is
    nearest (the earlier of two equally near), and ``days`` from it to the row's own time
    (negative if it comes later). Rows with an unknown key or time have none.

    Both tables are merged and sorted by (key, time), once in each direction, and the last
    event seen is carried along, so no row is paired with more than one event of its key.
    """
    known = left[time].isNotNull()
    for k in keys:
        known = known & left[k].isNotNull()
    asked, rest = left.where(known), left.where(~known)
    # of several events on one day one is enough
    events = right.na.drop("any", subset=[*keys, time]).select(*keys, time).distinct()
    day = F.unix_date(F.col(time))
    found = _nearest_one_way(asked, events, keys, day, F.col(time), "_last")
    found = _nearest_one_way(found, events, keys, -day, F.col(time), "_next")
    back, ahead = F.date_diff(time, "_last"), F.date_diff("_next", F.col(time))
    nearest = F.when(F.col("_next").isNull() | (back <= ahead), F.col("_last")).otherwise(F.col("_next"))
    found = found.select(*left.columns, nearest.alias("nearest"))
    out = found.unionByName(rest, allowMissingColumns=True)
    return out.withColumn("days", F.date_diff(time, "nearest"))
