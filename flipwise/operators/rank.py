"""Exact global ranks without a single-partition window.

``Window.partitionBy(stratum).orderBy(x)`` sends a whole stratum to one task;
with two classes that is half the data per task.  ``two_level_rank`` splits
the order into buckets that are monotone in the order key:

1. count rows per (stratum, bucket) - a small table, at most
   strata x buckets rows, built with partial aggregation;
2. running sum of those counts per stratum = the rank offset of each bucket
   (a window over the small table only);
3. join the offsets back (AQE broadcasts the table when its measured size
   allows, and keeps a shuffle join otherwise) and number rows inside each
   (stratum, bucket) window - many small windows, spread over all tasks.

The result is the same rank as the global window, ties included, because
equal order keys always share a bucket.  Buckets are a pure function of the
row, so a recomputed partition gets the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_level_rank(df: DataFrame, strata: list[str], order: list[Column], bucket: Column,
                   out: str = "rank", total_out: str | None = None) -> DataFrame:
    """Add ``out``: 0-based row number in ``order`` within each stratum.

    ``bucket`` must be non-decreasing in ``order`` and take few distinct values
    (e.g. 65 536); ties in ``order`` must be broken by the caller for a
    deterministic result.  ``total_out`` adds the stratum's row count (taken
    from the same small table, no extra pass over the rows).
    """
    b = df.withColumn("__bucket", bucket)
    counts = b.groupBy(*strata, "__bucket").agg(F.count(F.lit(1)).alias("__cnt"))
    before = (Window.partitionBy(*strata).orderBy("__bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    cols = [*strata, "__bucket",
            F.coalesce(F.sum("__cnt").over(before), F.lit(0)).cast("bigint").alias("__off")]
    if total_out:
        cols.append(F.sum("__cnt").over(Window.partitionBy(*strata)).cast("bigint").alias(total_out))
    offsets = counts.select(*cols)
    inner = Window.partitionBy(*strata, "__bucket").orderBy(*order)
    return (b.join(offsets, [*strata, "__bucket"], "inner")
            .withColumn(out, F.col("__off") + F.row_number().over(inner).cast("bigint") - F.lit(1))
            .drop("__bucket", "__off"))


def hash_order_key(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random order key: md5 of ``'<seed>:<id>'`` (hex)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_bucket(key: Column, hex_digits: int = 4) -> Column:
    """Bucket of an md5 hex key: its first ``hex_digits`` digits as a number
    (lower-case hex sorts like its value, so the bucket is monotone)."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("int")
