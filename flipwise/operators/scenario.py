"""What-if capacity scenarios.

For a segment with weekly capacity ``base`` and outcome rate ``b``, lowering
the rate to ``t`` percent frees capacity:

    extra/week = max(0, round_half_even(base * (1 - t/100) / (1 - b)) - base)
    extra/year = extra/week * 52
    value      = round_half_even(extra/year * 0.2) * 700

``b`` comes from a baseline table (one row per segment, e.g. the observed
rate of each diagnosis, or a single constant row).  Targets are expanded per
segment with a generator (``explode``), not a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def capacity_scenarios(baselines: DataFrame, rate: str = "baseline_rate",
                       targets: list[int] | None = None, base: int = C.CAPACITY_PER_WEEK,
                       weeks: int = C.WEEKS_PER_YEAR, share: float = C.CONVERSION_SHARE,
                       value_per: int = C.REVENUE_PER_PATIENT, baseline: float | None = None) -> DataFrame:
    """G1 + G2 for every (segment, target); ``baseline`` (such as
    ``config.BASELINE_FLIP_RATE``) replaces the segments' own rates."""
    if baseline is not None:
        baselines = baselines.withColumn(rate, F.lit(float(baseline)))
    targets = C.SCENARIO_TARGETS if targets is None else targets
    t = F.col("target_pct")
    projected = F.try_divide(F.lit(float(base)) * (F.lit(1.0) - t / F.lit(100)),
                             F.lit(1.0) - F.col(rate))
    extra = F.greatest(F.lit(0), F.rint(projected).cast("bigint") - F.lit(base))
    return (baselines.withColumn("target_pct", F.explode(F.array(*[F.lit(int(x)) for x in targets])))
            .withColumn("extra_per_week", extra)
            .withColumn("extra_per_year", F.col("extra_per_week") * F.lit(weeks))
            .withColumn("revenue", F.rint(F.col("extra_per_year") * F.lit(float(share))).cast("bigint")
                        * F.lit(value_per))
            .withColumn("projected_per_week", F.col("extra_per_week") + F.lit(base)))


def capacity_waterfall(scenarios: DataFrame, keys: list[str] | None = None,
                       base: int = C.CAPACITY_PER_WEEK) -> DataFrame:
    """(step, measure, value) rows per scenario: baseline, delta, total."""
    keys = list(keys or [])
    steps = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("Current Baseline").alias("label"),
                 F.lit("absolute").alias("measure"), F.lit(base).cast("bigint").alias("value")),
        F.struct(F.lit(1).alias("step"),
                 F.concat(F.lit("Reduce flip to "), F.col("target_pct").cast("string"), F.lit("%")).alias("label"),
                 F.lit("relative").alias("measure"), F.col("extra_per_week").cast("bigint").alias("value")),
        F.struct(F.lit(2).alias("step"), F.lit("Projected Capacity").alias("label"),
                 F.lit("total").alias("measure"), F.col("projected_per_week").cast("bigint").alias("value")))
    return scenarios.select(*keys, "target_pct", F.inline(steps))
