"""Cohort predicates.

Predicates are plain Catalyst expressions, so on a Parquet source the
comparisons and IN lists reach the scan as pushed filters (row-group
skipping), and nothing else is evaluated for excluded rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The option that stands for every value of a key.
ALL = "All Diagnoses"


def cohort_predicate(in_sets: dict[str, list] | None = None,
                     ranges: dict[str, tuple] | None = None,
                     include_null: dict[str, bool] | None = None):
    """Conjunction of ``col IN (...)`` and inclusive ``lo <= col <= hi``.

    T4: pandas ``isin`` matches a missing value when the option list holds
    one (option lists come from ``unique()``, which keeps it); SQL ``IN`` never
    matches NULL.  ``include_null[col]=True`` restores that behaviour; a
    ``None`` inside the value list does the same.  Range predicates drop NULLs.
    Used as a filter, a NULL predicate rejects the row, so no ``coalesce`` is
    needed - and none is used, because it would stop the IN lists and ranges
    from being pushed into the Parquet scan.
    """
    in_sets = in_sets or {}
    ranges = ranges or {}
    include_null = dict(include_null or {})
    parts = []
    for c, values in in_sets.items():
        vals = [v for v in values if v is not None]
        nulls = include_null.get(c, False) or len(vals) != len(values)
        p = F.col(c).isin(vals) if vals else F.lit(False)
        if nulls:
            p = p | F.col(c).isNull()
        parts.append(p)
    for c, (lo, hi) in ranges.items():
        parts += [F.col(c) >= F.lit(lo), F.col(c) <= F.lit(hi)]
    cond = F.lit(True)
    for p in parts:
        cond = cond & p
    return cond


def cohort_filter(df: DataFrame, in_sets=None, ranges=None, include_null=None) -> DataFrame:
    """Apply :func:`cohort_predicate`."""
    return df.where(cohort_predicate(in_sets, ranges, include_null))


def key_filter(df: DataFrame, col: str, value, all_value: str = ALL) -> DataFrame:
    """``col = value``, or every row when ``value`` is None or exactly the 'all' option."""
    if value is None or value == all_value:
        return df
    return df.where(F.col(col) == F.lit(value))


def option_values(df: DataFrame, col: str, keep_null: bool = False) -> DataFrame:
    """C4: distinct values of a column (sorted output is the caller's
    ``orderBy``); ``keep_null`` keeps the missing value as an option."""
    d = df.select(col).distinct()
    return d if keep_null else d.where(F.col(col).isNotNull())


def option_lists(df: DataFrame, cols: list[str], keep_null: dict[str, bool] | None = None) -> DataFrame:
    """C4 for several columns at once: long (column, value) table, one scan."""
    keep_null = keep_null or {}
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                                                  F.lit(keep_null.get(c, False)).alias("__null")) for c in cols])))
    return pairs.where(F.col("value").isNotNull() | F.col("__null")).select("column", "value").distinct()


def tier_filter(df: DataFrame, tier_col: str, tier: str) -> DataFrame:
    """The rows of one tier (an empty tier gives no rows)."""
    return df.where(F.col(tier_col) == F.lit(tier))
