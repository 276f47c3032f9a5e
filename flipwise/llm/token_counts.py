"""Token counts: batch encoding in an Arrow function that returns lengths only.

The scan deals the table out by bytes (``spark.sql.files.maxPartitionBytes``);
inside a task every Arrow batch is cut again into runs of rows of about
``tokens.SLICE_BYTES``, and a longer text goes through alone, split at safe
boundaries (``tokens``).  No shuffle, and no ids leave the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, whole_text
from .tokens import VOCABULARY, encoder, text_array


def token_length(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each whole text (null: empty), without special tokens around it."""

    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = encoder(vocabulary)
        for batch in batches:
            yield pa.array(count.lengths(text_array(batch)), pa.int64())

    lengths.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf("long")(lengths)(text)


def token_counts(docs: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts count 0; repeated rows and null ids each keep their
    row; other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = whole_text(text_col)
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                          token_length(text, vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
