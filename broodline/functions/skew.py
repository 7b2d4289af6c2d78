"""A join back to aggregated keys that no hot key slows down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodline.functions.nulls import free_name

#: A key is hot if it holds more than one row in SHARE; so there are fewer than SHARE hot keys.
SHARE = 1000


def join_by_share(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` on ``key``, with the columns of ``groups`` but ``size``.

    ``groups`` has one row for each key; ``size`` is the number of rows of the key (or an
    upper bound whose sum is at most ``total``). Keys above ``total / SHARE`` are fewer than
    ``SHARE``, whatever the table, and are broadcast; their rows leave the shuffle's key,
    spread by their other values. All other keys meet their rows in a shuffle where none
    holds more than one row in ``SHARE``. Null keys match nothing and are spread likewise.
    """
    hot = F.coalesce(F.col(size) * SHARE > F.lit(total), F.lit(False))
    new = [c for c in groups.columns if c not in (key, size)]
    here, spread = free_name(rows.columns, "is_hot"), free_name(rows.columns, "spread")
    names = {c: free_name(rows.columns, f"hot_{c}") for c in new}
    few = groups.where(hot).select(key, F.lit(True).alias(here), *(F.col(c).alias(n) for c, n in names.items()))
    # always 0, but no constant: the optimizer would take a constant out of the join's keys
    zero = F.pmod(F.coalesce(F.col(size), F.lit(0)), F.lit(1)).cast("long")
    rest = groups.where(~hot).select(key, zero.alias(spread), *new)
    marked = rows.join(F.broadcast(few), key, "left")
    aside = F.col(here).isNotNull() | F.col(key).isNull()
    marked = marked.withColumn(spread, F.when(aside, F.xxhash64(*rows.columns)).otherwise(F.lit(0)))
    # a hash of 0 changes nothing: a hot key is not in ``rest``, and null matches nothing
    joined = marked.join(rest, [key, spread], "left")
    return joined.select(*rows.columns, *(F.coalesce(names[c], c).alias(c) for c in new))
