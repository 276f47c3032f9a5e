"""Stratified train/test split and stratified k folds.

Rows are ordered inside each class by ``md5('<seed>:<id>')`` (a stable
pseudo-random permutation that does not depend on partitioning); the first
``ceil(test_fraction * n_class)`` rows of each class are the test set, so the
class proportions are exact per class.  Training rows get fold =
(rank among the class's training rows) mod k, so fold sizes differ by at most
one per class.  Ranks come from :func:`two_level_rank` (no single-task window).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import ratio
from .rank import hash_bucket, hash_order_key, two_level_rank


def assign_split(df: DataFrame, label: str = C.OUTCOME, id_col: str = C.ID,
                 test_fraction: float = C.TEST_FRACTION, seed: int = C.SPLIT_SEED,
                 n_folds: int | None = C.N_FOLDS, hex_digits: int = 4) -> DataFrame:
    """Add ``split`` ('train' / 'test') and ``fold`` (0..k-1 on training rows)."""
    key = hash_order_key(id_col, seed)
    keyed = df.withColumn("__key", key)
    ranked = two_level_rank(keyed, [label], [F.col("__key"), F.col(id_col)],
                            hash_bucket(F.col("__key"), hex_digits), out="__rank", total_out="__n")
    n_test = F.ceil(F.lit(float(test_fraction)) * F.col("__n").cast("double"))
    out = (ranked.withColumn("__ntest", n_test)
           .withColumn("split", F.when(F.col("__rank") < F.col("__ntest"), F.lit("test"))
                       .otherwise(F.lit("train"))))
    if n_folds:
        out = out.withColumn("fold", F.when(F.col("split") == "train",
                                            ((F.col("__rank") - F.col("__ntest")) % n_folds).cast("int")))
    return out.drop("__key", "__rank", "__n", "__ntest")


def split_balance(df: DataFrame, label: str = C.OUTCOME, split: str = "split") -> DataFrame:
    """rows, positives and positive rate per split."""
    return (df.groupBy(split).agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(label).cast("bigint").alias("n_positive"))
            .withColumn("positive_rate", ratio("n_positive", "n")))


def fold_sizes(df: DataFrame, label: str = C.OUTCOME, fold: str = "fold") -> DataFrame:
    """Rows per (fold, class) of the training rows."""
    return (df.where(F.col(fold).isNotNull()).groupBy(fold, label)
            .agg(F.count(F.lit(1)).alias("n")))


#: Statistics per aggregate, so that each stays below the field limit of whole-stage code generation.
STATS_AT_ONCE = 40


def standardise(df: DataFrame, cols: list[str], fit_filter=None, suffix: str = "",
                digits: int | None = None, binary: list[str] | None = None) -> DataFrame:
    """(x - mean) / population sd, statistics from the rows selected by
    ``fit_filter`` only (the training rows), applied to every row.

    A constant column gets scale 1 (centred only).  Columns named in
    ``binary`` hold 0 and 1 only: their sum p gives both, sd = sqrt(p (1 - p)).
    The statistics are one row, read by the driver and applied as constants.
    """
    fit = df.where(fit_filter) if fit_filter is not None else df
    flags = set(binary or [])
    stats = {f"__m{i}": F.avg(c) for i, c in enumerate(cols)} | {f"__s{i}": F.stddev_pop(c) for i, c in enumerate(cols) if c not in flags}
    names, row = list(stats), {}
    for a in range(0, len(names), STATS_AT_ONCE):
        row |= fit.agg(*[stats[n].alias(n) for n in names[a:a + STATS_AT_ONCE]]).first().asDict()
    new = {}
    for i, c in enumerate(cols):
        mean = row[f"__m{i}"]
        if mean is None:
            new[c + suffix] = F.lit(None).cast("double")
            continue
        sd = math.sqrt(mean * (1 - mean)) if c in flags else row[f"__s{i}"]
        e = (F.col(c) - F.lit(mean)) / F.lit(sd if sd > 0 else 1.0)
        if digits is not None:
            e = F.rint(e * F.lit(float(10 ** digits))) / F.lit(float(10 ** digits))
        new[c + suffix] = e
    return df.withColumns(new)
