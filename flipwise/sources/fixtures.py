"""Derived encounter tables built from the driver's star-schema tables.

None of the driver tables has the encounter shape, so ``raw_encounters``
derives one row per order: measures from the order's line items, keys from
the order and its customer, and the planted defects the cleaner must repair
(text in a numeric column, 0 as a missing marker, an impossible value,
missing measures and ages, unmapped codes).  The rules are the ones of
FIXTURES.md section 4; the DuckDB oracle uses that SQL text verbatim.

Plan shape at scale: line items are aggregated per order first (partial
aggregation before the shuffle), orders join customers on the customer key
and then the per-order aggregate on the order key.  Both are equi-joins of
large inputs, left to the optimizer (sort-merge, AQE may switch to broadcast
when a side is measured small at run time).  Only five columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .tables import table

# Codes assigned round-robin by order key; remainder 12 gives an unmapped code.
FIXTURE_CODE_CYCLE: list[int] = sorted(C.DRG_NAMES) + [999]

# Raw insurance category per market segment; other segments are 'Private'.
FIXTURE_SEGMENT_INSURANCE: dict[str, str] = {
    "AUTOMOBILE": "MEDICARE",
    "BUILDING": "MEDICARE OTHER",
    "FURNITURE": "MEDICAID STATE",
    "HOUSEHOLD": "MEDICAID OTHER",
}


def _code_of(key):
    expr = None
    for i, code in enumerate(FIXTURE_CODE_CYCLE[:-1]):
        cond = (key % len(FIXTURE_CODE_CYCLE)) == i
        expr = F.when(cond, code) if expr is None else expr.when(cond, code)
    return expr.otherwise(FIXTURE_CODE_CYCLE[-1])


def _insurance_of(seg):
    expr = None
    for s, ins in FIXTURE_SEGMENT_INSURANCE.items():
        expr = F.when(seg == s, ins) if expr is None else expr.when(seg == s, ins)
    return expr.otherwise("Private")


def raw_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw encounter table (input of the cleaner), one row per order."""
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.max("l_quantity").alias("q_max"),
               F.min("l_quantity").alias("q_min"),
               F.count(F.lit(1)).alias("n_lines")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    b = (orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
         .join(li, orders.o_orderkey == li.l_orderkey, "left")
         .select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ck"),
                 F.col("o_orderstatus").alias("st"), F.col("c_mktsegment").alias("seg"),
                 "q_max", "q_min"))
    k, ck, st = F.col("k"), F.col("ck"), F.col("st")
    q_max, q_min = F.col("q_max"), F.col("q_min")
    drg = _code_of(k)
    dbl = lambda e: e.cast("double")
    return b.select(
        k.alias(C.ID),
        drg.alias(C.CODE),
        dbl(F.when(k % 211 == 0, None).otherwise(19 + ck % 71)).alias(C.AGE),
        F.when(ck % 2 == 0, "Male").otherwise("Female").alias(C.GENDER),
        _insurance_of(F.col("seg")).alias(C.INSURANCE_RAW),
        dbl(80 + 2 * q_max).alias(C.BP_UPPER),
        dbl(F.when(q_min.isNull(), 0).otherwise(40 + q_min)).alias(C.BP_LOWER),
        F.when(q_max.isNull() | (k % 97 == 0), "#VALUE!")
         .otherwise((40 + 2 * q_max - q_min).cast("bigint").cast("string")).alias(C.BP_DIFF),
        dbl(F.when(k % 53 == 0, None).otherwise(50 + (k * 7) % 70)).alias("Pulse"),
        dbl(F.when(k % 59 == 0, None).otherwise(85 + (k * 11) % 16)).alias("PulseOximetry"),
        dbl(F.when(k % 499 == 0, 73).otherwise(10 + (ck * 3) % 16)).alias(C.RESP),
        dbl(F.when(k % 61 == 0, None).otherwise(96 + (k * 13) % 8)).alias("Temperature"),
        F.when((st == "F") | ((st == "P") & drg.isin(C.EXCLUSION_CODES)), 1)
         .otherwise(0).cast("int").alias(C.OUTCOME),
        dbl(F.coalesce(q_max, F.lit(10.0)) + F.when(st == "F", 24).otherwise(0)).alias(C.LOS),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second domain: document labels joined to document keys and size.

    Outcome ``quality`` / ``toxic``, keys ``lang`` / ``source``, measure
    ``n_chars``.  Only the four needed document columns are read, the
    document text never leaves the scan.
    """
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id", "inner")
