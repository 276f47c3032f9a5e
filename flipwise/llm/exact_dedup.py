"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters deal the rows out by ranges of their content (its first
characters, then a hash of all of it, so that splitters stay short), Spark's
external sort puts equal texts next to each other, and the window over the
sorted rows compares each row's whole text with its neighbour's.

A text that very many rows hold would make one long range: such texts are
counted by hash first (a map-side aggregation), their rows get a salt from
the id, so they spread over several ranges, and a second map-side aggregation
over those texts alone gives their largest id and count.  There are at most
``4 x partitions`` such texts by construction, so these two small tables are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

HEAD_CHARACTERS = 32
#: A text is split over ranges only beyond this many rows, whatever the partitions.
LEAST_HOT_ROWS = 500


def _annotated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as a struct ``__row`` with __id, __sha, __keep, __size, __first (the one row that stays)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("__row"),
                       F.col(id_col).alias("__id"), whole_text(text_col).alias("__text"),
                       F.col(text_col).isNull().alias("__null"))
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    hot_rows = max(LEAST_HOT_ROWS, docs.count() // (4 * parts))
    hot = rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    hot = F.broadcast(hot.select("__hash", F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__salts")))
    salted = rows.join(hot, "__hash", "left").withColumn("__salts", F.coalesce("__salts", F.lit(1))) \
        .withColumn("__salt", F.pmod(F.hash("__id"), F.col("__salts"))) \
        .withColumn("__head", F.substring("__text", 1, HEAD_CHARACTERS))
    content = ["__head", "__hash", "__salt"]
    whole = Window.partitionBy(*content, "__text").orderBy(F.col("__id").desc_nulls_last(), F.col("__null"))
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = salted.repartitionByRange(*content).withColumns({
        "__keep": F.first("__id").over(every), "__size": F.count(F.lit(1)).over(every),
        "__rank": F.row_number().over(whole), "__sha": F.sha2("__text", 256)})
    hottest = rows.join(hot, "__hash").groupBy(F.sha2("__text", 256).alias("__sha")) \
        .agg(F.max("__id").alias("__keep_all"), F.count(F.lit(1)).alias("__size_all"))
    joined = found.join(F.broadcast(hottest), "__sha", "left")
    return joined.select("__row", "__id", "__text", "__null", "__sha",
                         F.when(F.col("__size_all").isNull(), F.col("__keep")).otherwise(F.col("__keep_all")).alias("__keep"),
                         F.coalesce("__size_all", "__size").alias("__size"),
                         ((F.col("__rank") == 1) & (F.col("__size_all").isNull() | F.col("__keep").eqNullSafe(F.col("__keep_all"))))
                         .alias("__first"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text.  Of equal texts the row with the largest
    id stays (a null id only if all are null; of rows that repeat that id,
    one).  Other columns, whatever their names, change nothing; an empty
    table gives no rows.
    """
    found = _annotated(docs.select(id_col, text_col), id_col, text_col)
    return found.select(F.col("__id").alias("doc_id"), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
                        F.col("__first").alias("kept"), F.col("__sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Null ids and texts as in ``exact_groups``; of rows equal in id and text one stays; an empty table gives no rows.
    """
    found = _annotated(docs, id_col, text_col).where("__first")
    text = F.when(~F.col("__null"), F.col("__text"))
    return found.select(*((text if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns))
