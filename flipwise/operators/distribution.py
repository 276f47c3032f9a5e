"""Distribution summaries: box statistics, outliers, density, histograms.

These tables replace what a charting library computes internally, so the
exact rules are ours and stated here:

* quartiles use linear interpolation between order statistics (R-7, the
  rule of ``percentile``), fences at 1.5 IQR, whiskers at the most extreme
  values inside the fences, standard deviation of the population;
* density is a Gaussian kernel estimate with Silverman's bandwidth, computed
  from per-group binned counts (``n_bins`` equal-width bins between the
  group's min and max) and evaluated on ``n_grid`` equally spaced points;
* histogram bins have a "nice" width (1, 2 or 5 times a power of ten) that is
  at least range / n_bins, aligned on multiples of the width.

Plan shape: rows are aggregated once to moments per group and once to distinct
values with counts per group (``quantile.collapse``); quartiles, whiskers,
outlier counts and bins come from the latter.  A per-group statistics table
(one row per group) meets values or rows on (group, salt), the salt being a
hash of the value: two groups of all rows never mean two tasks.  The density
join pairs at most ``n_grid x n_bins`` rows per group, whatever the data size.
Nothing is rounded unless digits are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact_sum import exact_sums
from ..functions.numeric import fixed, ratio
from ..session import ensure_checkpoint_dir
from .quantile import collapse, exact_quantiles


def _keys_not_null(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    cond = F.col(value).isNotNull()
    for g in groups:
        cond = cond & F.col(g).isNotNull()
    return df.where(cond)


#: Tasks that a group's values are dealt to when they meet the group's statistics.
SALTS = 32


def _join_groups(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Join of two per-group tables (one row, or a bounded number of rows, per group)."""
    if groups:
        return left.join(right, groups, "inner")
    return left.crossJoin(F.broadcast(right))  # one-row statistics table


def with_stats(rows: DataFrame, stats: DataFrame, groups: list[str], spread: str) -> DataFrame:
    """``rows`` with their group's statistics, joined on (group, salt); the salt is a hash of the column ``spread``."""
    if not groups:
        return rows.crossJoin(F.broadcast(stats))  # one-row statistics table
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*groups, "__salt"], "inner").drop("__salt")


def _quartiles(df: DataFrame, value: str, groups: list[str], method: str) -> DataFrame:
    """(groups.., __q = [q1, median, q3])."""
    if method == "exact":
        return _grouped(_keys_not_null(df, value, groups), groups).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("__q"))
    qs = exact_quantiles(df, value, [0.25, 0.5, 0.75], groups)
    return _grouped(qs, groups).agg(F.array(*[F.max(F.when(F.col("p") == p, F.col("quantile"))) for p in (0.25, 0.5, 0.75)]).alias("__q"))


def _grouped(df: DataFrame, groups: list[str]):
    return df.groupBy(*groups) if groups else df.groupBy()


def box_stats(df: DataFrame, value: str, groups: list[str] | None = None,
              sd_digits: int | None = None, method: str = "distributed") -> DataFrame:
    """Per group: n, q1, median, q3, IQR, fences, mean, population sd, min, max.

    Quartiles come from :mod:`quantile`; ``method='exact'`` takes the built-in
    aggregate with the same values, whose state is one counter per distinct
    value.  ``sd_digits`` rounds the standard deviation.
    """
    groups = list(groups or [])
    base = _keys_not_null(df, value, groups)
    sd = F.stddev_pop(value)
    moments = _grouped(base, groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (fixed(sd, sd_digits) if sd_digits is not None else sd).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    st = _join_groups(moments, _quartiles(df, value, groups, method), groups)
    return (st.select(*groups, "n", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"),
                      F.col("__q")[2].alias("q3"), "mean", "sd", "min", "max")
            .withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("lower_fence", F.col("q1") - F.lit(1.5) * F.col("iqr"))
            .withColumn("upper_fence", F.col("q3") + F.lit(1.5) * F.col("iqr")))


def box_summary(df: DataFrame, value: str, groups: list[str] | None = None,
                sd_digits: int | None = None, method: str = "distributed") -> DataFrame:
    """Box statistics plus whiskers and the outlier count, from the distinct values of each group."""
    groups = list(groups or [])
    st = box_stats(df, value, groups, sd_digits, method)
    kind = df.schema[value].dataType
    v, cnt = F.col("__v"), F.col("__cnt")
    j = with_stats(collapse(df, value, groups), st.select(*groups, "lower_fence", "upper_fence"), groups, "__v")
    out = (v < F.col("lower_fence")) | (v > F.col("upper_fence"))
    wh = _grouped(j, groups).agg(F.min(F.when(v >= F.col("lower_fence"), v)).cast(kind).alias("lower_whisker"),
                                 F.max(F.when(v <= F.col("upper_fence"), v)).cast(kind).alias("upper_whisker"),
                                 F.coalesce(F.sum(F.when(out, cnt)), F.lit(0)).alias("n_outliers"))
    return _join_groups(st, wh, groups)


def box_outliers(df: DataFrame, value: str, groups: list[str] | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """The rows outside the 1.5 IQR fences of their group."""
    groups = list(groups or [])
    keep = list(keep or [])
    st = box_stats(df, value, groups).select(*groups, "lower_fence", "upper_fence")
    base = _keys_not_null(df, value, groups).select(*keep, *[g for g in groups if g not in keep], *([] if value in keep else [value]))
    v = F.col(value)
    return (with_stats(base, st, groups, value)
            .where((v < F.col("lower_fence")) | (v > F.col("upper_fence")))
            .select(*keep, *[g for g in groups if g not in keep], *([] if value in keep else [value])))


SQRT_2PI = math.sqrt(2.0 * math.pi)


def density(df: DataFrame, value: str, groups: list[str] | None = None,
            n_grid: int = 64, n_bins: int = 256, digits: int | None = None,
            method: str = "distributed") -> DataFrame:
    """Gaussian kernel density per group on a grid (violin outline).

    An approximation: the kernel is summed over ``n_bins`` bin centres, not over
    single values; more bins come closer.

    Bandwidth h = 0.9 * min(sd, IQR / 1.34) * n^(-1/5); if that spread is 0 the
    sd is used, and 1.0 when the group is constant.
    """
    groups = list(groups or [])
    base = _keys_not_null(df, value, groups)
    moments = _grouped(base, groups).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
                                         F.stddev_pop(value).alias("sd"))
    st = (_join_groups(moments, _quartiles(df, value, groups, method), groups)
          .withColumn("__a", F.least(F.col("sd"), (F.col("__q")[2] - F.col("__q")[0]) / F.lit(1.34)))
          .withColumn("__spread", F.when(F.col("__a") > 0, F.col("__a"))
                      .when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)))
          .withColumn("h", F.lit(0.9) * F.col("__spread") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
          .withColumn("w", (F.col("hi") - F.col("lo")) / F.lit(float(n_bins)))
          .select(*groups, "n", "lo", "hi", "h", "w"))
    v = F.col("__v")
    binned = (with_stats(collapse(df, value, groups), st.select(*groups, "lo", "w"), groups, "__v")
              .withColumn("__b", F.when(F.col("w") > 0,
                                        F.least(F.floor((v - F.col("lo")) / F.col("w")),
                                                F.lit(n_bins - 1))).otherwise(F.lit(0)))
              .groupBy(*groups, "__b", "lo", "w").agg(F.sum("__cnt").alias("__c"))
              .select(*groups, (F.col("lo") + (F.col("__b") + F.lit(0.5)) * F.col("w")).alias("__center"),
                      "__c"))
    grid = (st.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
            .withColumn("x", F.col("lo") + F.col("point").cast("double")
                        * (F.col("hi") - F.col("lo")) / F.lit(float(n_grid - 1)))
            .select(*groups, "point", "x", "n", "h"))
    z = (F.col("x") - F.col("__center")) / F.col("h")
    contrib = F.col("__c") * F.exp(F.lit(-0.5) * z * z)
    pairs = _join_groups(grid, binned, groups)
    out = (pairs.groupBy(*groups, "point", "x", "n", "h")
           .agg(F.sum(contrib).alias("__s"))
           .withColumn("density", F.col("__s") / (F.col("n") * F.col("h") * F.lit(SQRT_2PI))))
    if digits is not None:
        out = out.withColumn("density", fixed("density", digits))
    return out.select(*groups, "point", "x", "density")


def exact_moments(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Per group: n, sum, mean, population sd, the same bits in any partitioning.

    Two passes over the distinct values with counts: the sum is exact and
    rounded once, the squared distances from its mean likewise.  The sums of the
    first pass, a row per group, are checkpointed inside the call.
    """
    groups = list(groups or [])
    rows = collapse(df, value, groups)
    v, n = F.col("__v"), F.col("__cnt")
    total = _join_groups(_grouped(rows, groups).agg(F.sum(n).alias("n")), exact_sums(rows, {"sum": v}, groups, n), groups) \
        .withColumn("mean", ratio("sum", "n"))
    ensure_checkpoint_dir(df.sparkSession)
    total = total.checkpoint()
    apart = v - F.col("mean")
    squares = exact_sums(with_stats(rows, total.select(*groups, "mean"), groups, "__v"), {"__s2": apart * apart}, groups, n)
    return _join_groups(total, squares, groups).select(*groups, "n", "sum", "mean", F.sqrt(ratio("__s2", "n")).alias("sd"))


def density_bounded(df: DataFrame, value: str, groups: list[str] | None = None, n_grid: int = 64, n_bins: int = 256,
                    method: str = "distributed") -> DataFrame:
    """D10 with its error: (groups.., point, x, density, error_bound).

    Each value is shared between the two nodes around it (linear binning,
    ``n_bins`` intervals between the group's min and max), which replaces the
    kernel between two nodes by its chord.  A chord of width w is off by at most
    w^2 / 8 times the greatest second derivative, and that of the Gaussian
    kernel of bandwidth h is 1 / (h^3 sqrt(2 pi)), so the density is within

        error_bound = w^2 / (8 h^3 sqrt(2 pi))

    of the sum over all values, whatever the data (but for rounding).  A group
    of one distinct value has bound 0.  All sums are exact, so the numbers do
    not depend on the partitioning.  Bandwidth and grid as in :func:`density`;
    at most ``n_grid * (n_bins + 1)`` pairs per group meet.  The numbers of each
    group (a row) are checkpointed inside the call: the nodes and the grid read
    them, and would else both repeat the sums and quartiles they come from.
    """
    groups = list(groups or [])
    base = _keys_not_null(df, value, groups)
    ends = _grouped(base, groups).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    moments = _join_groups(exact_moments(df, value, groups).select(*groups, "n", "sd"), ends, groups)
    st = (_join_groups(moments, _quartiles(df, value, groups, method), groups)
          .withColumn("__a", F.least(F.col("sd"), (F.col("__q")[2] - F.col("__q")[0]) / F.lit(1.34)))
          .withColumn("__spread", F.when(F.col("__a") > 0, F.col("__a")).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)))
          .withColumn("h", F.lit(0.9) * F.col("__spread") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
          .withColumn("w", (F.col("hi") - F.col("lo")) / F.lit(float(n_bins)))
          .select(*groups, "n", "lo", "hi", "h", "w"))
    ensure_checkpoint_dir(df.sparkSession)
    st = st.checkpoint()
    at = F.when(F.col("w") > 0, (F.col("__v") - F.col("lo")) / F.col("w")).otherwise(F.lit(0.0))
    left = F.least(F.floor("__at"), F.lit(n_bins - 1))
    share = F.col("__at") - F.col("__left")
    near = (with_stats(collapse(df, value, groups), st.select(*groups, "lo", "w"), groups, "__v")
            .withColumn("__at", at).withColumn("__left", left))
    halves = F.array(F.struct(F.col("__left").alias("__node"), (F.lit(1.0) - share).alias("__share")),
                     F.struct((F.col("__left") + 1).alias("__node"), share.alias("__share")))
    nodes = exact_sums(near.select(*groups, "__cnt", F.inline(halves)), {"__c": F.col("__share")}, [*groups, "__node"], F.col("__cnt"))
    grid = (st.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
            .withColumn("x", F.col("lo") + F.col("point").cast("double") * (F.col("hi") - F.col("lo")) / F.lit(float(n_grid - 1))))
    z = (F.col("x") - (F.col("lo") + F.col("__node") * F.col("w"))) / F.col("h")
    # the numbers of a grid point are keys of the sum, so the grid is not computed again to be joined to it
    kernels = exact_sums(_join_groups(grid, nodes, groups), {"__s": F.col("__c") * F.exp(F.lit(-0.5) * z * z)}, [*groups, "point", "x", "n", "h", "w"])
    bound = F.col("w") * F.col("w") / (F.lit(8.0 * SQRT_2PI) * F.col("h") * F.col("h") * F.col("h"))
    return (kernels
            .select(*groups, "point", "x", (F.col("__s") / (F.col("n") * F.col("h") * F.lit(SQRT_2PI))).alias("density"), bound.alias("error_bound")))


def nice_width(span, n_bins: int):
    """Smallest of 1, 2, 5 or 10 times 10^k that is >= span / n_bins (1 if span is 0)."""
    raw = span / F.lit(float(n_bins))
    p = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / p
    step = F.when(m <= 1, p).when(m <= 2, 2 * p).when(m <= 5, 5 * p).otherwise(10 * p)
    return F.when(span > 0, step).otherwise(F.lit(1.0))


def histogram(df: DataFrame, value: str, by: str | None = None, n_bins: int = 20) -> DataFrame:
    """Percent-normalised histogram of ``value``, one series per ``by`` value.

    One width for all series (global range of the non-NULL values), so the
    series are comparable; percent is of the series' own total.
    """
    base = df.where(F.col(value).isNotNull())
    if by:
        base = base.where(F.col(by).isNotNull())
    rng = base.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).select(
        nice_width(F.col("__hi") - F.col("__lo"), n_bins).alias("width"))
    keys = [by] if by else []
    binned = (base.select(*keys, value).crossJoin(F.broadcast(rng))  # one-row width
              .withColumn("bin_start", F.floor(F.col(value) / F.col("width")) * F.col("width"))
              .groupBy(*keys, "bin_start", "width").agg(F.count(F.lit(1)).alias("count")))
    tot = F.sum("count").over(Window.partitionBy(*keys)) if keys else F.sum("count").over(Window.partitionBy())
    return (binned.withColumn("bin_end", F.col("bin_start") + F.col("width"))
            .withColumn("pct", ratio(F.col("count") * F.lit(100.0), tot))
            .select(*keys, "bin_start", "bin_end", "count", "pct"))
