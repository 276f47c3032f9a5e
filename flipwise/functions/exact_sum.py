"""Sums of doubles that do not depend on the order of the rows.

A sum of doubles changes in its last bits with the partitioning.  Here each
value is split by its exponent into at most three integer limbs of 32 bits
(weights 2^(32 j)); limbs of one weight add up as DECIMAL, which is exact and
mergeable, so rows shrink map-side to at most ``HIGH - LOW + 1`` limbs a group.
The limbs of a group then carry into base 2^32 digits, and the leading 96 bits
with a sticky bit round once to a double: the result is the exact sum, rounded
half to even.

Rules: NULL values are skipped, a group with only NULLs gives NULL; NaN, or
both infinities, give NaN; one infinity gives it.  Bits of a value below
2^-1056 (part of the subnormal range) are cut, alike in any order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32
#: Least and greatest limb weight exponent, in limbs.
LOW, HIGH = -33, 31
#: Limbs that hold what the carries of very many rows push up.
ROOM = 5
_NAN, _POSITIVE, _NEGATIVE, _MISSING = 100, 101, 102, 103
_TOTAL = "decimal(38,0)"
_BASE = Decimal(2 ** BITS)


def _constants(values) -> Column:
    """One array constant; the optimizer folds it."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast("array<double>")


def _cut(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def limb_totals(df: DataFrame, values: dict[str, Column], groups: list[str], weight: Column | None = None) -> DataFrame:
    """(groups.., __k, __limb, __total): the additive state of the sums of ``values`` (times an integer ``weight``).

    States of more rows merge by adding ``__total``.
    """
    each = F.array(*[F.struct(F.lit(k).alias("__k"), e.cast("double").alias("__x")) for k, e in enumerate(values.values())])
    w = (F.lit(1) if weight is None else weight).cast("decimal(20,0)")
    rows = df.select(*groups, w.alias("__w"), F.inline(each))
    x = F.col("__x")
    code = (F.when(x.isNull(), _MISSING).when(F.isnan(x), _NAN).when(x == float("inf"), _POSITIVE)
            .when(x == float("-inf"), _NEGATIVE))
    scale = _constants(2.0 ** (BITS * j) for j in range(LOW, HIGH + 1))
    at = lambda j: scale[j - F.lit(LOW)]
    top = F.greatest(F.lit(LOW + 2), F.least(F.lit(HIGH), F.floor(F.log2(F.abs("__x")) / F.lit(float(BITS))).cast("int")))
    parts = (rows.withColumn("__code", code).withColumn("__x", F.when(F.col("__code").isNull(), x).otherwise(F.lit(0.0)))
             .withColumn("__j", F.when(x != 0, top).otherwise(F.lit(LOW + 2)))
             .withColumn("__p0", _cut(x / at(F.col("__j")))).withColumn("__r", x - F.col("__p0") * at(F.col("__j")))
             .withColumn("__p1", _cut(F.col("__r") / at(F.col("__j") - 1))).withColumn("__r", F.col("__r") - F.col("__p1") * at(F.col("__j") - 1))
             .withColumn("__p2", _cut(F.col("__r") / at(F.col("__j") - 2))))
    limb = lambda j, p: F.struct(j.cast("int").alias("__limb"), p.cast("decimal(12,0)").alias("__p"))
    j = F.col("__j")
    long = parts.select(*groups, "__k", "__w", F.inline(F.array(
        limb(F.coalesce("__code", j), F.col("__p0")), limb(j - 1, F.col("__p1")), limb(j - 2, F.col("__p2")))))
    # a zero low limb says nothing; the first one stays, so that a group of zeros has a sum
    long = long.where((F.col("__p") != 0) | (F.col("__limb") >= LOW + 2))
    return long.groupBy(*groups, "__k", "__limb").agg(F.sum(F.col("__p") * F.col("__w")).cast(_TOTAL).alias("__total"))


def _carried(sign: int) -> Column:
    """(carry, digits in base 2^32, lowest first) of the limbs in the map ``__m``, times ``sign``."""
    def step(acc, j):
        s = acc["carry"] + F.lit(sign).cast("decimal(1,0)") * F.coalesce(F.try_element_at(F.col("__m"), j), F.lit(0).cast(_TOTAL))
        digit = F.pmod(s.cast(_TOTAL), F.lit(_BASE).cast(_TOTAL))
        carry = F.call_function("div", (s - digit).cast(_TOTAL), F.lit(_BASE).cast(_TOTAL))
        return F.struct(carry.cast(_TOTAL).alias("carry"), F.concat(acc["digits"], F.array(digit.cast("bigint"))).alias("digits"))
    start = F.struct(F.lit(0).cast(_TOTAL).alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    return F.aggregate(F.sequence(F.lit(LOW), F.lit(HIGH + ROOM)), start, step)


def sums_of(totals: DataFrame, names: list[str], groups: list[str]) -> DataFrame:
    """(groups.., names..): the rounded sums of a :func:`limb_totals` state; at most ``HIGH - LOW + 1 + ROOM`` rows meet per sum."""
    m = totals.groupBy(*groups, "__k").agg(F.map_from_entries(F.collect_list(F.struct("__limb", "__total"))).alias("__m"))
    c = m.withColumn("__up", _carried(1)).withColumn("__negative", F.col("__up.carry") < 0)
    c = c.withColumn("__d", F.when(F.col("__negative"), _carried(-1)).otherwise(F.col("__up"))["digits"])
    first = F.array_max(F.transform("__d", lambda d, i: F.when(d != 0, i)))
    c = c.withColumn("__i", F.greatest(F.coalesce(first, F.lit(0)), F.lit(2)))
    digit = lambda back: F.col("__d")[F.col("__i") - back].cast("decimal(20,0)")
    lead = (digit(0) * F.lit(_BASE * _BASE) + digit(1) * F.lit(_BASE) + digit(2)).cast("decimal(30,0)")
    sticky = F.exists(F.slice("__d", F.lit(1), F.col("__i") - 2), lambda d: d != 0).cast("int")
    weights = _constants(2.0 ** (BITS * (i + LOW) - 1) for i in range(HIGH + ROOM - LOW - 1) if BITS * (i + LOW) - 1 < 1024)
    size = (lead * F.lit(2) + sticky).cast("double") * weights[F.col("__i") - 2]
    has = lambda key: F.array_contains(F.map_keys("__m"), key)
    value = (F.when(has(_NAN) | (has(_POSITIVE) & has(_NEGATIVE)), F.lit(float("nan"))).when(has(_POSITIVE), F.lit(float("inf")))
             .when(has(_NEGATIVE), F.lit(float("-inf"))).when(has(_MISSING) & (F.size("__m") == 1), F.lit(None).cast("double"))
             .when(F.col("__negative"), -size).otherwise(size))
    done = c.select(*groups, "__k", value.alias("__v"))
    cols = [F.max(F.when(F.col("__k") == k, F.col("__v"))).alias(n) for k, n in enumerate(names)]
    return (done.groupBy(*groups) if groups else done.groupBy()).agg(*cols)


def exact_sums(df: DataFrame, values: dict[str, Column], groups: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(groups.., one column per name): sums of the value columns, each rounded once; the same bits in any partitioning."""
    groups = list(groups or [])
    return sums_of(limb_totals(df, values, groups, weight), list(values), groups)
