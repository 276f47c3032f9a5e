"""Cohort cube: additive partial states of the outcome profiles over (insurance, gender, age, diagnosis) (C2 with D1, D3, D7, D11).

A page of profiles asks many aggregates of the same filtered rows.  The cube
holds counts and sums per combination of keys, so its size follows the
distinct combinations, not the rows; it is written once, new rows are added by
merging the cube of the new rows (``merge``), and every filter on its keys
(``cohort.cohort_filter`` works on it as on rows) is answered without
reading a row again.  Sums of whole-numbered measures are exact, hence equal
to those over rows; of others they may differ in the last digits, as sums do
by partitioning.

NULL keys are cells of their own, as rows with NULL keys are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import pct, ratio
from .distribution import nice_width

KEYS = [C.INSURANCE, C.GENDER, C.AGE, C.DIAGNOSIS]


def cohort_cube(df: DataFrame, keys: list[str] | None = None, outcome: str = C.OUTCOME, los: str = C.LOS,
                flags: list[str] | None = None) -> DataFrame:
    """One row per combination of the keys: n, outcome counts, sums and counts of the measure and of each flag by outcome."""
    keys, flags = keys or KEYS, C.FLAG_COLUMNS if flags is None else flags
    y = F.col(outcome)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).cast("bigint").alias("y_sum"), F.count(y).alias("y_n"), F.count_if(y == 0).alias("y_0"),
            F.sum(los).cast("double").alias("m_sum"), F.count(los).alias("m_n")]
    for v in (0, 1):
        held = F.when(y == v, F.col(los))
        aggs += [F.sum(held).cast("double").alias(f"m{v}_sum"), F.count(held).alias(f"m{v}_n")]
        for i, flag in enumerate(flags):
            held = F.when(y == v, F.col(flag))
            aggs += [F.sum(held).cast("bigint").alias(f"f{i}_{v}_sum"), F.count(held).alias(f"f{i}_{v}_n")]
    return df.groupBy(*keys).agg(*aggs)


def merge(first: DataFrame, *more: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The cube of all rows that the given cubes hold."""
    keys = keys or KEYS
    for cube in more:
        first = first.unionByName(cube)
    return first.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in first.columns if c not in keys])


def rates(cube: DataFrame, keys) -> DataFrame:
    """D1 from the cube (or its filtered cells): count, total, rate and percent by key(s); NULL keys drop out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    for k in keys:
        cube = cube.where(F.col(k).isNotNull())
    return (cube.groupBy(*keys).agg(F.sum("y_sum").alias("Flipped_Count"), F.sum("y_n").alias("Total"))
            .withColumn("Flip_Rate", ratio("Flipped_Count", "Total")).withColumn("Flip_Pct", pct("Flip_Rate")))


def kpis(cube: DataFrame, age: str = C.AGE) -> DataFrame:
    """D3 from the cube: the same columns as ``profile.kpi_summary``."""
    years = F.when(F.col(age).isNotNull(), F.col("n"))
    one = cube.agg(*[F.sum(c).alias(c) for c in ("n", "y_sum", "y_n", "y_0", "m_sum", "m_n", "m0_sum", "m0_n", "m1_sum", "m1_n")],
                   F.sum(F.col(age) * years).alias("a_sum"), F.sum(years).alias("a_n"))
    return (one.withColumn("flip_rate", ratio("y_sum", "y_n")).select(
        F.coalesce("n", F.lit(0)).alias("n_total"), F.col("y_sum").alias("n_flipped"), "flip_rate", pct("flip_rate").alias("flip_pct"),
        F.coalesce("y_0", F.lit(0)).alias("n_stayed"), pct(ratio("y_0", "n")).alias("stayed_pct"), ratio("m_sum", "m_n").alias("los_mean_all"),
        ratio("m1_sum", "m1_n").alias("los_mean_flipped"), ratio("m0_sum", "m0_n").alias("los_mean_stayed"), ratio("a_sum", "a_n").alias("age_mean")))


def flag_prevalence(cube: DataFrame, flags: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """D7 from the cube: the same columns as ``profile.flag_prevalence``."""
    flags = C.FLAG_COLUMNS if flags is None else flags
    labels = C.FLAG_LABELS if labels is None else labels
    one = cube.agg(*[F.sum(c).alias(c) for i in range(len(flags)) for v in (0, 1) for c in (f"f{i}_{v}_sum", f"f{i}_{v}_n")])
    share = lambda i, v: pct(ratio(f"f{i}_{v}_sum", f"f{i}_{v}_n"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("flag"), F.lit(label).alias("label"),
                                                  share(i, 0).alias("stayed_pct"), share(i, 1).alias("flipped_pct"))
                                         for i, (f, label) in enumerate(zip(flags, labels))])))


def histogram_by_outcome(cube: DataFrame, value: str = C.AGE, outcome: str = C.OUTCOME, n_bins: int = 20) -> DataFrame:
    """D11 of a key of the cube, one series per outcome: the same columns as ``distribution.histogram``."""
    cells = cube.where(F.col(value).isNotNull()).select(value, F.inline(F.array(
        F.struct(F.lit(0).alias(outcome), F.col("y_0").alias("__c")), F.struct(F.lit(1).alias(outcome), F.col("y_sum").alias("__c"))))).where("__c > 0")
    width = cells.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(nice_width(F.col("hi") - F.col("lo"), n_bins).alias("width"))
    binned = (cells.crossJoin(F.broadcast(width))  # one row
              .withColumn("bin_start", F.floor(F.col(value) / F.col("width")) * F.col("width"))
              .groupBy(outcome, "bin_start", "width").agg(F.sum("__c").alias("count")))
    total = F.sum("count").over(Window.partitionBy(outcome))
    return (binned.withColumn("bin_end", F.col("bin_start") + F.col("width"))
            .withColumn("pct", ratio(F.col("count") * F.lit(100.0), total)).select(outcome, "bin_start", "bin_end", "count", "pct"))
