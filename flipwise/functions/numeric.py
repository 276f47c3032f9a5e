"""Numeric column expressions.

All are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """B1 / T5: text to number, unparsable text becomes NULL (ANSI-safe)."""
    return col_(c).try_cast("double")


def round_half_even(c, digits: int = 1) -> Column:
    """``Series.round(d)`` semantics, i.e. ``rint(x * 10^d) / 10^d``.

    Spark's ``round`` is half-up and ``bround`` rounds the decimal value; the
    analysed pipeline scales first and rounds half-to-even on the double.
    """
    scale = float(10 ** digits)
    return F.rint(col_(c) * F.lit(scale)) / F.lit(scale)


def pct(rate, digits: int = 1) -> Column:
    """``(rate * 100).round(digits)``; multiply first, as the pipeline does."""
    return round_half_even(col_(rate) * F.lit(100.0), digits)


def ratio(num, den) -> Column:
    """Division that yields NULL instead of failing on a zero divisor."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def capped_share(value, maximum, cap: float = 100.0) -> Column:
    """``min(value / maximum * 100, cap)``."""
    return F.least(ratio(value, maximum) * F.lit(100.0), F.lit(cap))


def direction(diff) -> Column:
    """Arrow for the sign of a difference (``↑`` when positive)."""
    return F.when(col_(diff) > 0, F.lit("↑")).otherwise(F.lit("↓"))


def fixed(c, digits: int) -> Column:
    """Round a statistic whose last bits depend on summation order.

    Sums of non-integer doubles differ in the last ulp between engines and
    partitionings; reporting them to ``digits`` decimals makes them stable.
    """
    return round_half_even(c, digits)
