"""Bins, bands and rule flags as CASE chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_

_OPS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


def right_closed_bin(c, edges: list[float], labels: list[str]) -> Column:
    """``pd.cut`` semantics, bins ``(e[i], e[i+1]]``; outside or NULL -> NULL.

    ``Bucketizer`` is left-closed, so it is not used.
    """
    x = col_(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def right_closed_ordinal(c, edges: list[float]) -> Column:
    """0-based bin number of :func:`right_closed_bin` (NULL outside)."""
    x = col_(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def band(c, bands: list[tuple[float, str]], default: str) -> Column:
    """First band whose bound is strictly exceeded, else ``default``."""
    x = col_(c)
    expr = None
    for bound, lab in bands:
        cond = x > F.lit(float(bound))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(default))


def rule_flag(c, op: str, threshold: float) -> Column:
    """Strict comparison as 0/1; a NULL measure gives 0."""
    return F.coalesce(_OPS[op](col_(c), F.lit(float(threshold))), F.lit(False)).cast("int")


def member_flag(c, values: list) -> Column:
    """Set membership as 0/1; NULL gives 0."""
    return F.coalesce(col_(c).isin(list(values)), F.lit(False)).cast("int")


def equals_flag(c, value) -> Column:
    """Equality as 0/1; NULL gives 0."""
    return F.coalesce(col_(c) == F.lit(value), F.lit(False)).cast("int")
