"""Cleaning operators (B1-B7) and the cleaning summary (B6, A4, D3 counts).

Plan shape: B1-B5 are one narrow projection (whole-stage codegen, no
shuffle).  B7 needs the medians of the projected data first: distinct values with
counts are shuffled for them, never rows, and the results are constants of the
final projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import to_double
from .quantile import median_map


def coerce_numeric(df: DataFrame, col: str) -> DataFrame:
    """B1: text column to double, unparsable text -> NULL."""
    return df.withColumn(col, to_double(col))


def recompute_missing(df: DataFrame, target: str, upper: str, lower: str) -> DataFrame:
    """B2: where ``target`` is NULL use ``upper - lower`` (run before B3)."""
    return df.withColumn(target, F.coalesce(F.col(target), F.col(upper) - F.col(lower)))


def sentinel_to_null(df: DataFrame, col: str, sentinel: float = 0.0) -> DataFrame:
    """A sentinel value means missing."""
    return df.withColumn(col, F.when(F.col(col) == F.lit(sentinel), F.lit(None).cast("double"))
                         .otherwise(F.col(col)))


def null_when_both_missing(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    """``target`` becomes NULL where both ``a`` and ``b`` are NULL."""
    return df.withColumn(target, F.when(F.col(a).isNull() & F.col(b).isNull(),
                                        F.lit(None).cast("double")).otherwise(F.col(target)))


def screen_upper_bounds(df: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """Values above a plausibility bound become NULL (NULL stays NULL)."""
    bounds = C.UPPER_BOUNDS if bounds is None else bounds
    return df.withColumns({
        c: F.when(F.col(c) > F.lit(float(b)), F.lit(None).cast("double")).otherwise(F.col(c))
        for c, b in bounds.items()})


def median_row(df: DataFrame, cols: list[str], method: str = "distributed",
               accuracy: int = 100_000) -> DataFrame:
    """One-row table of per-column medians, NULLs skipped.

    ``distributed`` is the exact median (mean of the two middle values) with
    bounded work per task at any number of distinct values (:mod:`quantile`;
    all columns in one pass after an unpivot).  ``exact`` gives the same values
    from the built-in aggregate, which keeps one counter per distinct value in
    one task.  ``approx`` uses the bounded-memory quantile sketch.
    """
    if method == "distributed":
        return median_map(df, cols)
    if method == "exact":
        aggs = [F.median(c).alias(c) for c in cols]
    elif method == "approx":
        aggs = [F.percentile_approx(c, 0.5, accuracy).cast("double").alias(c) for c in cols]
    else:
        raise ValueError(f"unknown median method {method!r}")
    return df.agg(*aggs)


def impute_median(df: DataFrame, cols: list[str] | None = None,
                  method: str = "distributed") -> DataFrame:
    """Fill NULLs of each column with that column's own median.

    Columns are imputed independently (so an imputed difference need not equal
    the difference of imputed parts, as in the analysed pipeline).  The medians
    (one number per column) are computed inside the call and enter the plan as
    constants: no join, and unused columns still prune away with their sources.
    """
    cols = C.IMPUTED_VITALS if cols is None else cols
    med = median_row(df, cols, method).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c]).cast("double")) for c in cols})


def repair_vitals(df: DataFrame) -> DataFrame:
    """B1 -> B2 -> B3 -> B4 -> B5 in the pipeline's order, one projection."""
    d = coerce_numeric(df, C.BP_DIFF)
    d = recompute_missing(d, C.BP_DIFF, C.BP_UPPER, C.BP_LOWER)
    d = sentinel_to_null(d, C.BP_LOWER, 0.0)
    d = null_when_both_missing(d, C.BP_DIFF, C.BP_UPPER, C.BP_LOWER)
    return screen_upper_bounds(d)


def clean_vitals(df: DataFrame, method: str = "distributed") -> DataFrame:
    """B1-B5 then B7."""
    return impute_median(repair_vitals(df), C.IMPUTED_VITALS, method)


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_null) for every column in one scan (one agg + unpivot)."""
    cols = df.columns if cols is None else cols
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null"),
                               F.lit(i).alias("position"))
                      for i, c in enumerate(cols)])
    return one.select(F.inline(pairs))


def imputation_report(raw: DataFrame, cols: list[str] | None = None,
                      method: str = "distributed") -> DataFrame:
    """B6 + B7: per imputed column, NULLs before imputation and the median used."""
    cols = C.IMPUTED_VITALS if cols is None else cols
    repaired = repair_vitals(raw)
    counts = repaired.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    one = counts.crossJoin(median_row(repaired, cols, method))  # one row each
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_missing"),
                              F.col(c).alias("median"))
                     for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


def cleaning_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """A4 + B6 counts of the cleaning run, one row.

    n_rows / n_columns of the raw table; how many differences were recomputed
    (missing after coercion), lower readings that were 0, screened impossible
    values, and NULL cells left in the cleaned table over all its columns.
    """
    b = (raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(to_double(C.BP_DIFF).isNull()).alias("n_diff_recomputed"),
        F.count_if(F.col(C.BP_LOWER) == 0).alias("n_lower_zero"),
        F.count_if(F.col(C.RESP) > F.lit(C.UPPER_BOUNDS[C.RESP])).alias("n_resp_screened"))
        .withColumn("n_columns", F.lit(len(raw.columns)).cast("bigint")))
    left = cleaned.agg(F.sum(sum((F.col(c).isNull().cast("bigint") for c in cleaned.columns),
                                 F.lit(0).cast("bigint"))).alias("n_missing_remaining"))
    return b.crossJoin(left)
