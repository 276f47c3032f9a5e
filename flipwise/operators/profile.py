"""Outcome profiling (D1-D8, D12-D14 basics).

Each profile is one hash aggregate: partial aggregation on every map task,
one shuffle of at most (groups x partitions) rows, final aggregation.  Keys
with a third of all rows cost nothing extra: the partial aggregate collapses
them before the shuffle.  Statistics that compare outcomes are conditional
aggregates in the same pass, never two filtered scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import capped_share, direction, pct, ratio, round_half_even
from .quantile import STATE_VALUES, cut_bucket, exact_median, sketch_cuts
from .rank import two_level_rank


def _not_null(keys: list[str]):
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return cond


def outcome_rate(df: DataFrame, keys, outcome: str = C.OUTCOME,
                 count_name: str = "Flipped_Count", total_name: str = "Total",
                 rate_name: str = "Flip_Rate", pct_name: str = "Flip_Pct") -> DataFrame:
    """(sum, count, mean, percent) of a 0/1 outcome by key(s).

    T1: rows with a NULL key are dropped (pandas ``groupby`` default).
    T10: the count counts non-NULL outcomes.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    y = F.col(outcome)
    return (df.where(_not_null(keys))
            .groupBy(*keys)
            .agg(F.sum(y).cast("bigint").alias(count_name), F.count(y).alias(total_name))
            .withColumn(rate_name, ratio(count_name, total_name))
            .withColumn(pct_name, pct(rate_name)))


def outcome_profiles(df: DataFrame, profiles: dict[str, list[str]], outcome: str = C.OUTCOME) -> DataFrame:
    """D1 over several key sets in one scan: profile, the keys (typed, NULL where the profile lacks one), count, total, rate, percent.

    One aggregate over GROUPING SETS; rows with a NULL in a key are dropped
    from the profiles that have that key only (T1).
    """
    keys = list(dict.fromkeys(k for ks in profiles.values() for k in ks))
    y = F.col(outcome)
    number = lambda ks: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks)
    name = F.lit(None).cast("string")
    whole = F.lit(True)
    for label, ks in profiles.items():
        name = F.when(F.col("__set") == number(ks), F.lit(label)).otherwise(name)
        held = _not_null(ks) if ks else F.lit(True)
        whole = whole & F.when(F.col("__set") == number(ks), held).otherwise(F.lit(True))
    grouped = df.groupingSets([[F.col(k) for k in ks] for ks in profiles.values()], *keys) \
        .agg(F.grouping_id().alias("__set"), F.sum(y).cast("bigint").alias("Flipped_Count"), F.count(y).alias("Total"))
    return (grouped.where(whole).withColumn("Flip_Rate", ratio("Flipped_Count", "Total")).withColumn("Flip_Pct", pct("Flip_Rate"))
            .select(name.alias("profile"), *keys, "Flipped_Count", "Total", "Flip_Rate", "Flip_Pct"))


def overall_rate(df: DataFrame, outcome: str = C.OUTCOME) -> DataFrame:
    """One-row overall rate (mean of the non-NULL outcomes)."""
    y = F.col(outcome)
    return (df.agg(F.sum(y).cast("bigint").alias("__s"), F.count(y).alias("__n"))
            .select(ratio("__s", "__n").alias("Overall_Rate"))
            .withColumn("Overall_Pct", pct("Overall_Rate")))


def with_overall_rate(profile: DataFrame, df: DataFrame, outcome: str = C.OUTCOME) -> DataFrame:
    """Attach the overall rate (a one-row broadcast) to every group."""
    return profile.crossJoin(F.broadcast(overall_rate(df, outcome)))


def kpi_summary(df: DataFrame, outcome: str = C.OUTCOME, los: str = C.LOS,
                age: str = C.AGE) -> DataFrame:
    """D3: the KPI row in one scan (the analysed pipeline scans eight times)."""
    y = F.col(outcome)
    return (df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum(y).cast("bigint").alias("n_flipped"),
        F.count_if(y == 0).alias("n_stayed"),
        F.count(y).alias("__n_y"),
        F.avg(los).alias("los_mean_all"),
        F.avg(F.when(y == 1, F.col(los))).alias("los_mean_flipped"),
        F.avg(F.when(y == 0, F.col(los))).alias("los_mean_stayed"),
        F.avg(age).alias("age_mean"))
        .withColumn("flip_rate", ratio("n_flipped", "__n_y"))
        .withColumn("flip_pct", pct("flip_rate"))
        .withColumn("stayed_pct", pct(ratio("n_stayed", "n_total")))
        .select("n_total", "n_flipped", "flip_rate", "flip_pct", "n_stayed", "stayed_pct",
                "los_mean_all", "los_mean_flipped", "los_mean_stayed", "age_mean"))


def rate_heatmap(df: DataFrame, row_key: str = C.DIAGNOSIS, col_key: str = C.AGE_GROUP,
                 levels: list[str] | None = None, outcome: str = C.OUTCOME) -> DataFrame:
    """D4, long form: percent outcome for every observed row key x observed
    column level; combinations without rows are filled with 0.

    One pivot aggregate over the known column levels (no pairing of key
    lists), unpivoted; a level that no row has is dropped (by one broadcast row
    of level totals).
    """
    levels = C.AGE_LABELS if levels is None else levels
    base = df.where(_not_null([row_key, col_key]))
    wide = base.groupBy(row_key).pivot(col_key, levels).agg(
        F.sum(outcome).alias("s"), F.count(outcome).alias("n"))
    cells = F.array(*[F.struct(F.lit(lv).alias(col_key), F.col(f"{lv}_s").alias("__s"),
                               F.col(f"{lv}_n").alias("__n")) for lv in levels])
    long = wide.select(row_key, F.inline(cells))
    # whether a level has rows: one row of totals, not a window that holds every row key of a level
    totals = base.agg(*[F.count_if(F.col(col_key) == lv).alias(f"t{i}") for i, lv in enumerate(levels)])
    seen = F.lit(0)
    for i, lv in enumerate(levels):
        seen = F.when(F.col(col_key) == lv, F.col(f"t{i}")).otherwise(seen)
    return (long.crossJoin(F.broadcast(totals)).where(seen > 0)
            .select(row_key, col_key,
                    F.coalesce(pct(ratio("__s", "__n")), F.lit(0.0)).alias("Flip_Pct")))


def rate_heatmap_wide(df: DataFrame, row_key: str = C.DIAGNOSIS, col_key: str = C.AGE_GROUP,
                      levels: list[str] | None = None, outcome: str = C.OUTCOME) -> DataFrame:
    """D4, wide form: one column per column-key level (explicit pivot values,
    so no extra distinct pass), empty cells 0."""
    levels = C.AGE_LABELS if levels is None else levels
    base = df.where(_not_null([row_key, col_key]))
    wide = base.groupBy(row_key).pivot(col_key, levels).agg(
        F.sum(outcome).alias("s"), F.count(outcome).alias("n"))
    return wide.select(row_key, *[
        F.coalesce(pct(ratio(f"{lv}_s", f"{lv}_n")), F.lit(0.0)).alias(lv) for lv in levels])


def _by_outcome_agg(df: DataFrame, cols: list[str], outcome: str, extra_minmax: bool):
    y = F.col(outcome)
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.avg(F.when(y == 0, F.col(c))).alias(f"s{i}"))
        aggs.append(F.avg(F.when(y == 1, F.col(c))).alias(f"f{i}"))
        if extra_minmax:
            aggs.append(F.min(c).alias(f"lo{i}"))
            aggs.append(F.max(c).alias(f"hi{i}"))
    return df.agg(*aggs)


def vitals_normalised(df: DataFrame, cols: list[str] | None = None,
                      labels: list[str] | None = None, outcome: str = C.OUTCOME) -> DataFrame:
    """Per measure, mean by outcome min-max normalised to 0-100 (1 decimal).

    T6: a constant column (max = min) gives NULL, not an error.
    """
    cols = C.PROFILE_VITALS if cols is None else cols
    labels = C.PROFILE_VITAL_LABELS if labels is None else labels
    one = _by_outcome_agg(df, cols, outcome, True)
    rows = []
    for i, (c, lab) in enumerate(zip(cols, labels)):
        span = F.col(f"hi{i}") - F.col(f"lo{i}")
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("measure"), F.lit(lab).alias("label"),
            F.col(f"s{i}").alias("stayed_mean"), F.col(f"f{i}").alias("flipped_mean"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            pct(ratio(F.col(f"s{i}") - F.col(f"lo{i}"), span)).alias("stayed_norm"),
            pct(ratio(F.col(f"f{i}") - F.col(f"lo{i}"), span)).alias("flipped_norm")))
    return one.select(F.inline(F.array(*rows)))


def vitals_compare(df: DataFrame, cols: list[str] | None = None,
                   labels: list[str] | None = None, outcome: str = C.OUTCOME,
                   diff: str = "raw") -> DataFrame:
    """D6 (+B19): mean by outcome (1 decimal), difference, direction, share of max.

    ``diff='raw'`` rounds the difference of the raw means; ``'rounded'``
    subtracts the rounded means (the two orders in the analysed code).  The
    share is the rounded flipped mean over the column maximum, capped at 100.
    """
    cols = C.PROFILE_VITALS if cols is None else cols
    labels = C.PROFILE_VITAL_LABELS if labels is None else labels
    one = _by_outcome_agg(df, cols, outcome, True)
    rows = []
    for i, (c, lab) in enumerate(zip(cols, labels)):
        s, f = F.col(f"s{i}"), F.col(f"f{i}")
        sr, fr = round_half_even(s, 1), round_half_even(f, 1)
        d = round_half_even(f - s, 1) if diff == "raw" else round_half_even(fr - sr, 1)
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("measure"), F.lit(lab).alias("label"),
            sr.alias("stayed_mean"), fr.alias("flipped_mean"), d.alias("difference"),
            direction(d).alias("direction"), F.abs(d).alias("abs_difference"),
            capped_share(fr, F.col(f"hi{i}")).alias("pct_of_max")))
    return one.select(F.inline(F.array(*rows)))


def flag_prevalence(df: DataFrame, flags: list[str] | None = None,
                    labels: list[str] | None = None, outcome: str = C.OUTCOME) -> DataFrame:
    """Percent of rows with each flag, by outcome (1 decimal)."""
    flags = C.FLAG_COLUMNS if flags is None else flags
    labels = C.FLAG_LABELS if labels is None else labels
    one = _by_outcome_agg(df, flags, outcome, False)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(fl).alias("flag"), F.lit(lab).alias("label"),
                     pct(F.col(f"s{i}")).alias("stayed_pct"), pct(F.col(f"f{i}")).alias("flipped_pct"))
            for i, (fl, lab) in enumerate(zip(flags, labels))]
    return one.select(F.inline(F.array(*rows)))


def median_order(df: DataFrame, key: str = C.DIAGNOSIS, value: str = C.LOS,
                 method: str = "distributed") -> DataFrame:
    """Per-key median, with its descending rank (key as tie-break).

    ``distributed`` computes exact medians with bounded work per task
    (:mod:`quantile`); ``exact`` is the built-in aggregate with the same
    values.  Keys whose values are all NULL keep a row, ranked last.  Up to
    ``STATE_VALUES`` keys (they are counted) are ranked in one window, more by
    buckets of the median.
    """
    base = df.where(F.col(key).isNotNull())
    if method == "distributed":
        agg = base.select(key).distinct().join(exact_median(base, value, [key]), key, "left")
    else:
        m = F.median(value) if method == "exact" else F.percentile_approx(value, 0.5, 100_000).cast("double")
        agg = base.groupBy(key).agg(m.alias("median"))
    order = [F.col("median").desc_nulls_last(), F.col(key)]
    if agg.count() <= STATE_VALUES:
        one = Window.partitionBy(F.lit(0)).orderBy(*order)
        return agg.withColumn("order", F.row_number().over(one))
    cuts = sketch_cuts(agg, "median", 64)
    bucket = F.coalesce(-cut_bucket("median", cuts), F.lit(1))
    return two_level_rank(agg, [], order, bucket, out="order").withColumn("order", (F.col("order") + 1).cast("int"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per non-NULL value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def band_rates(profile: DataFrame, pct_col: str = "Flip_Pct", bands=None,
               default: str = C.BAND_DEFAULT, out: str = "Severity") -> DataFrame:
    """B18 on a profile: severity band of each group's percent."""
    from ..functions.binning import band
    bands = C.RATE_BANDS if bands is None else bands
    return profile.withColumn(out, band(pct_col, bands, default))
