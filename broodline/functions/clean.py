"""Cleaning rules: experiment recoding, ID sentinels, protocol-version merge.

The reference applies *different* rules in different scripts; each is kept as its own
named constant so an operator states which rule it follows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
# Focal species code.
SPECIES = "PARMAJ"
# ExperimentID placeholders that mean "no experiment" in every script.
EXPERIMENT_NONE = ("NA;NA;NA", "NA", "FALSE")
# Extra placeholders treated as "no experiment" only when building pairs.
EXPERIMENT_NONE_PAIRING_EXTRA = ("", "UNKNOWN")
# Substring marking a control treatment, which is "no experiment".
CONTROL_MARKER = "control"
# Pair building: IDs that mean "unknown bird" and become NULL (before upper-casing).
FEMALE_UNKNOWN_PAIRING = ("1000000",)
MALE_UNKNOWN_PAIRING = ("1000000", "UNKNOWN")
# Breeding records: rows with these IDs are dropped.
FEMALE_DROP_BREEDING = ("0", "1", "1e+06")
MALE_DROP_BREEDING = ("0", "1")
# Fledge metrics: female totals are not formed for these IDs.
FEMALE_NO_TOTAL_FLEDGE = ("0", "1", "1e+06")
# Clutch types and their pairing order; any other non-NULL text has no order.
CLUTCH_ORDER = (("first", 1), ("replacement", 2), ("second", 3))
CLUTCH_ORDER_NULL = 4
# ---------------------------------------------------------------------------


def recode_experiment(c: Column | str) -> Column:
    """ExperimentID with placeholders and controls set to NULL; other text kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(list(EXPERIMENT_NONE)) | c.contains(CONTROL_MARKER),
                  F.lit(None).cast("string")).otherwise(c)


def experiment_flag(c: Column | str, blanks_are_none: bool = True) -> Column:
    """Boolean "is an experiment" (never NULL).

    ``blanks_are_none=True`` is the pair-building rule, where ``""`` and ``UNKNOWN`` are
    also placeholders; the other scripts count those as experiments.
    """
    c = F.col(c) if isinstance(c, str) else c
    none = list(EXPERIMENT_NONE) + (list(EXPERIMENT_NONE_PAIRING_EXTRA) if blanks_are_none else [])
    return ~(c.isNull() | c.isin(none) | c.contains(CONTROL_MARKER))


def clutch_order(c: Column | str) -> Column:
    """first=1, replacement=2, second=3, NULL=4, any other text NULL."""
    c = F.col(c) if isinstance(c, str) else c
    e = None
    for name, val in CLUTCH_ORDER:
        e = F.when(c == name, F.lit(val)) if e is None else e.when(c == name, F.lit(val))
    return e.when(c.isNull(), F.lit(CLUTCH_ORDER_NULL)).cast("int")


def date_observed_columns(df: DataFrame) -> list[str]:
    """Columns whose name contains ``Date_observed`` (case-insensitive, as tidyselect)."""
    return [c for c in df.columns if "date_observed" in c.lower()]


def coalesce_versions(df: DataFrame, spec: dict[str, tuple[str, str]],
                      types: dict[str, str] | None = None) -> DataFrame:
    """Merge two protocol versions: ``out = primary`` when present else ``fallback``.

    ``spec`` maps an output name to ``(primary, fallback)``. Either input column may be
    absent from the schema (it then reads as NULL), so one code path serves both versions.
    """
    types = types or {}
    cols = set(df.columns)
    out = {}
    for name, (primary, fallback) in spec.items():
        a = F.col(primary) if primary in cols else F.lit(None)
        b = F.col(fallback) if fallback in cols else F.lit(None)
        e = F.coalesce(a, b)
        out[name] = e.cast(types[name]) if name in types else e
    return df.withColumns(out)
