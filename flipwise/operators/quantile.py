"""Exact quantiles with bounded work and state per task.

Rows collapse to distinct values with counts per group (partial aggregation,
so a hot group or value shrinks before the shuffle).  Everything after works
on those.  How many the largest group has is counted first:

* up to ``STATE_VALUES`` a group's values fit one aggregation buffer, and the
  built-in weighted ``percentile`` takes them;
* beyond, each group gets cut points of its own from a mergeable sketch of its
  distinct values, as many as its size asks for, so a small group beside a huge
  one is cut as evenly.  Running totals over the small (group, bucket) table
  tell which bucket holds each wanted position, and only the values of those
  buckets are ranked, each (group, bucket) in a window of its own, and
  interpolated like ``percentile`` (R-7).

Both give the same numbers.  Joins and windows go by (group, bucket) or
(group, salt), never by a large group alone.  A position that no bucket holds
cannot occur; it would raise an error, not give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_BUCKETS = 512
#: Distinct values of a group that one aggregation buffer or one window may hold, and of a bucket beyond that.
STATE_VALUES, BUCKET_VALUES = 65_536, 8_192
#: Tasks that a large group's values are dealt to when they meet the group's cut points.
SALTS = 32


def largest_group(counted: DataFrame, groups: list[str]) -> int:
    """Rows of the largest group of a collapsed table (one job, one number)."""
    n = F.count(F.lit(1)).alias("n")
    return (counted.groupBy(*groups).agg(n).agg(F.max("n")) if groups else counted.agg(n)).first()[0] or 0


def group_cuts(values: DataFrame, value: str, groups: list[str], n_buckets: int = N_BUCKETS,
               bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """(groups.., __cuts): ascending cut points of each group's rows, a bucket for each ``bucket_values`` of them, at most ``n_buckets``.

    One aggregate of mergeable sketches.  The arrays end in infinities so that
    all have the same length.
    """
    probs = [i / n_buckets for i in range(1, n_buckets)]
    grouped = values.groupBy(*groups) if groups else values.groupBy()
    sketched = grouped.agg(F.count(F.lit(1)).alias("__d"), F.percentile_approx(F.col(value).cast("double"), probs, 8 * n_buckets).alias("__all"))
    size = F.greatest(F.lit(1), F.least(F.lit(n_buckets), F.ceil(F.col("__d") / F.lit(bucket_values)))).cast("int")
    some = F.when(F.col("__size") > 1, F.transform(F.sequence(F.lit(1), F.col("__size") - 1), lambda i: F.element_at(
        "__all", F.greatest(F.lit(1), F.floor(i * F.lit(n_buckets) / F.col("__size")).cast("int"))))).otherwise(F.array().cast("array<double>"))
    pad = F.array_repeat(F.lit(float("inf")), _padded(n_buckets) - 1 - F.size("__some"))
    return sketched.withColumn("__size", size).withColumn("__some", F.array_sort(F.array_distinct(some))) \
        .select(*groups, F.concat("__some", pad).alias("__cuts"))


def _padded(n_buckets: int) -> int:
    size = 1
    while size < n_buckets:
        size *= 2
    return size


def with_bucket(values: DataFrame, cuts: DataFrame, value: str, groups: list[str], n_buckets: int = N_BUCKETS) -> DataFrame:
    """``values`` with __b, the number of their group's cuts at or below the value.

    A binary search as one projection of built-in comparisons per halving,
    inside generated code; rows meet the cuts on (group, salt), where a group
    may hold most of the rows.
    """
    if groups:
        salted = values.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
        copies = cuts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = salted.join(copies, [*groups, "__salt"]).drop("__salt")
    else:
        rows = values.crossJoin(F.broadcast(cuts))  # one row
    rows = rows.withColumn("__b", F.lit(0))
    for step in _halves(_padded(n_buckets)):
        more = F.element_at("__cuts", F.col("__b") + F.lit(step)) <= F.col(value).cast("double")
        rows = rows.withColumn("__b", F.col("__b") + F.when(more, F.lit(step)).otherwise(F.lit(0)))
    return rows.drop("__cuts")


def sketch_cuts(df: DataFrame, value: str, n_buckets: int = N_BUCKETS) -> list[float]:
    """At most ``n_buckets - 1`` ascending cut points of a column's non-NULL values (one job, one bounded row)."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.select(F.col(value).cast("double").alias("v")).agg(F.percentile_approx("v", probs, 8 * n_buckets)).first()
    return sorted(set(row[0] or []))


def cut_bucket(value: str | Column, cuts: list[float]) -> Column:
    """Number of cuts at or below a value, by binary search in a constant array."""
    size = 1
    while size <= len(cuts):
        size *= 2
    padded = [repr(float(c)) for c in cuts] + ["Infinity"] * (size - 1 - len(cuts))
    if size == 1:
        return F.lit(0)
    table = F.split(F.lit(",".join(padded)), ",").cast("array<double>")  # folded into one constant
    steps = F.array(*(F.lit(s) for s in _halves(size)))
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.element_at(table, at + step) <= v, step).otherwise(F.lit(0)))


def _halves(size: int) -> list[int]:
    out = []
    while size > 1:
        size //= 2
        out.append(size)
    return out


def collapse(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """(groups.., __v, __cnt): distinct non-NULL values of each group of non-NULL keys, with their counts."""
    cond = F.col(value).isNotNull()
    for g in groups:
        cond = cond & F.col(g).isNotNull()
    return df.where(cond).groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__cnt"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], groups: list[str] | None = None,
                    n_buckets: int = N_BUCKETS, state_values: int = STATE_VALUES, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """Rows (groups..., p, quantile) for every group and probability, equal to ``percentile``.

    Groups without values have no rows.  ``state_values`` is the size up to
    which a group goes through one aggregation buffer.
    """
    groups = list(groups or [])
    keys = [*groups, "__b"]
    values = collapse(df, value, groups)
    if largest_group(values, groups) <= state_values:
        one = (values.groupBy(*groups) if groups else values.groupBy()).agg(F.percentile("__v", probs, F.col("__cnt")).alias("__q"))
        rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col("__q")[i].alias("quantile")) for i, p in enumerate(probs)])
        return one.where("__q IS NOT NULL").select(*groups, F.inline(rows))
    values = with_bucket(values, group_cuts(values, "__v", groups, n_buckets, bucket_values), "__v", groups, n_buckets)
    totals = values.groupBy(*keys).agg(F.sum("__cnt").alias("__in"))
    group = [F.col(g) for g in groups] or [F.lit(0)]
    upto = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("__end", F.sum("__in").over(upto)).withColumn("__n", F.sum("__in").over(Window.partitionBy(*group)))
    wanted = []
    for p in probs:
        h = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        wanted += [F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("__side"), position.cast("bigint").alias("__at"), h.alias("__h"))
                   for side, position in (("lo", F.floor(h)), ("hi", F.ceil(h)))]
    targets = totals.select(*keys, (F.col("__end") - F.col("__in")).alias("__start"), "__end", F.inline(F.array(*wanted))) \
        .where((F.col("__at") >= F.col("__start")) & (F.col("__at") < F.col("__end"))) \
        .select(*keys, "p", "__side", "__h", (F.col("__at") - F.col("__start")).alias("__rel"))
    inside = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.join(targets.select(*keys).distinct(), keys, "left_semi").withColumn("__to", F.sum("__cnt").over(inside))
    hit = ranked.join(targets, keys).where((F.col("__rel") < F.col("__to")) & (F.col("__rel") >= F.col("__to") - F.col("__cnt")))
    ends = hit.groupBy(*groups, "p").agg(F.max(F.when(F.col("__side") == "lo", F.col("__v"))).alias("__vlo"),
                                         F.max(F.when(F.col("__side") == "hi", F.col("__v"))).alias("__vhi"), F.max("__h").alias("__h"))
    h, lo, hi = F.col("__h"), F.floor("__h").cast("double"), F.ceil("__h").cast("double")
    q = (F.when(F.col("__vlo").isNull() | F.col("__vhi").isNull(), F.raise_error(F.lit("a quantile position was not found")).cast("double"))
         .when((lo == hi) | (F.col("__vlo") == F.col("__vhi")), F.col("__vlo"))
         .otherwise((hi - h) * F.col("__vlo") + (h - lo) * F.col("__vhi")))
    return ends.select(*groups, "p", q.alias("quantile"))


def exact_median(df: DataFrame, value: str, groups: list[str] | None = None, n_buckets: int = N_BUCKETS,
                 state_values: int = STATE_VALUES) -> DataFrame:
    """Rows (groups..., median) via :func:`exact_quantiles`."""
    return exact_quantiles(df, value, [0.5], groups, n_buckets, state_values).select(*(groups or []), F.col("quantile").alias("median"))


def median_map(df: DataFrame, cols: list[str], n_buckets: int = N_BUCKETS) -> DataFrame:
    """One-row table of the exact medians of several columns (one pass after an unpivot; NULL for a column without values)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__val")) for c in cols])))
    found = exact_median(long, "__val", ["__col"], n_buckets)
    return found.agg(*[F.max(F.when(F.col("__col") == c, F.col("median"))).alias(c) for c in cols])
