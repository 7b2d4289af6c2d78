"""NA-aware building blocks.

R's tidyverse and SQL differ in a handful of places that decide results here:
``n_distinct`` counts NA as a value, ``%in%`` never yields NA, ``distinct(.keep_all)``
keeps the first row in *input order*, ``arrange`` sorts NA last, joins match NA keys.
Each helper below is a plain Column / DataFrame expression (no UDF), so everything
stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_distinct_na(c) -> Column:
    """Aggregate: distinct count in which NULL counts as one more value (R ``n_distinct``)."""
    c = _c(c)
    return (F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))).cast("bigint")


def sole_value(c) -> Column:
    """Aggregate: the only non-null value, or NULL when there are none or several."""
    c = _c(c)
    return F.when(F.min(c) == F.max(c), F.min(c))


def count_true(c) -> Column:
    """Aggregate: number of rows where the predicate is TRUE, as BIGINT."""
    return F.count_if(_c(c)).cast("bigint")


def not_in(c, values: Iterable) -> Column:
    """``!(x %in% values)``: never NULL, so NULL ``x`` is kept by a filter."""
    return ~F.coalesce(_c(c).isin(list(values)), F.lit(False))


def safe_div(a, b) -> Column:
    """Division that yields NULL where R would give NaN/Inf (0/0, x/0, NULL)."""
    return F.try_divide(_c(a), _c(b))


def _halves(x):
    """Two doubles of at most 27 bits each whose sum is ``x`` exactly."""
    big = x * 134217729.0  # 2 ** 27 + 1
    high = big - (big - x)
    return high, x - high


def r_round(c, digits: int = 2) -> Column:
    """R's ``round``: the nearest number of ``digits`` decimals to the *stored* double, a tie
    going to the even digit. 0.15 is stored below its half, so it rounds to 0.1; 0.25 is a tie.

    A scaled number that looks like a half is one only if the product was exact: the error of
    the product, which is a double too, tells on which side of the half the number lies.
    """
    x, scale = _c(c).cast("double"), 10.0 ** digits
    scaled = x * scale
    (x_high, x_low), (s_high, s_low) = _halves(x), _halves(scale)
    error = ((x_high * s_high - scaled) + x_high * s_low + x_low * s_high) + x_low * s_low
    even = F.rint(scaled)
    half = F.abs(scaled - even) == 0.5
    whole = F.when(half & (error > 0), scaled + 0.5).when(half & (error < 0), scaled - 0.5).otherwise(even)
    # from 2 ** 52 on a double has no decimals to round
    return F.when(F.abs(scaled) < 2.0 ** 52, whole / scale + 0.0).otherwise(x)


def asc_nl(*cols) -> list[Column]:
    """Sort keys ascending with NULL last (R ``arrange``); Spark defaults to NULL first."""
    return [_c(c).asc_nulls_last() for c in cols]


def order_struct(order: Sequence) -> Column:
    """A struct whose natural ordering is 'ascending, NULL last' on each field."""
    fields = []
    for i, c in enumerate(order):
        c = _c(c)
        fields.append(c.isNull().alias(f"_n{i}"))
        fields.append(c.alias(f"_v{i}"))
    return F.struct(*fields)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``distinct(keys, .keep_all = TRUE)`` with an explicit input order.

    Written as an aggregation (``min_by`` on an NA-last order struct), so a hot key is
    reduced map-side before the shuffle instead of being sorted in one task.
    ``order`` must make rows unique within a key (end it with ``row_ord``).
    """
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), order_struct(order)).alias("_kf"))
    return agg.select(*keys, *[F.col(f"_kf.{c}").alias(c) for c in others])


def first_last_by(value, order: Sequence, first_name: str, last_name: str) -> list[Column]:
    """Aggregates: value of the first and of the last row by ``order`` (NULL last)."""
    o = order_struct(order)
    return [F.min_by(_c(value), o).alias(first_name), F.max_by(_c(value), o).alias(last_name)]


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores after it until it is none of ``taken``."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Equi-join where NULL keys match NULL keys (dplyr's default ``na_matches``)."""
    ren = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(ren)
    cond = [left[k].eqNullSafe(r[ren[k]]) for k in keys]
    out = left.join(r, on=cond, how=how)
    return out.drop(*ren.values())


def left_plus_missing(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
                      right_keys: Sequence[str], present: DataFrame | None = None) -> DataFrame:
    """Full outer join for a ``right`` side that is unique per key, written skew-safe.

    A full outer sort-merge join cannot be split by AQE when one key is hot, so it is
    expressed as ``left LEFT JOIN right`` (AQE can split or broadcast) plus the right rows
    whose key never occurs on the left (anti-join against the *distinct* left keys, which
    were reduced map-side first). Output keys carry the left names; right keys must be
    non-NULL (callers guarantee it), so left rows with a NULL key have no partner: one more
    key spreads them instead of their meeting in the partition of the NULL key.
    ``present``: rows with the same known keys as ``left``, where those are cheaper to make;
    else ``left`` is computed twice.
    """
    ren = dict(zip(right_keys, left_keys))
    r = right.withColumnsRenamed(ren)
    present = left if present is None else present
    known = reduce(and_, (F.col(k).isNotNull() for k in left_keys))
    spread = free_name([*left.columns, *r.columns], "_spread")
    # always 0, but no constant: the optimizer would take a constant out of the join's keys
    zero = F.pmod(F.xxhash64(*left_keys), F.lit(1).cast("bigint"))
    marked = left.withColumn(spread, F.when(known, F.lit(0).cast("bigint")).otherwise(F.xxhash64(*left.columns)))
    matched = marked.join(r.withColumn(spread, zero), on=[*left_keys, spread], how="left").drop(spread)
    missing = r.join(present.where(known).select(*left_keys).distinct(), on=list(left_keys), how="left_anti")
    return matched.unionByName(missing, allowMissingColumns=True)
