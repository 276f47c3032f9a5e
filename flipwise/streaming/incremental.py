"""Incremental outcome profiles over a stream of encounter files.

The analysed pipeline recomputes its profiles on every dashboard refresh.
On Spark the same operators run on a Structured Streaming source: new files
in a folder are cleaned row by row and folded into the running per-key
aggregate held in Spark's state store (checkpointed with the query), so a
refresh reads the state instead of rescanning history.

Only row-local steps can run per micro-batch.  Median imputation needs the
medians of the whole table, so a streaming job takes them as a fixed one-row
table (fitted once on the batch history with ``clean.median_row``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators.clean import repair_vitals
from ..operators.features import derive_features
from ..operators.profile import outcome_rate


def encounter_stream(spark: SparkSession, folder: str, schema: T.StructType | str,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``folder`` as an unbounded table."""
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def clean_stream(raw: DataFrame, medians: DataFrame) -> DataFrame:
    """B1-B5 per row, B7 with the medians of the first row of ``medians`` as constants, B8-B14."""
    cols = [c for c in C.IMPUTED_VITALS if c in medians.columns]
    med = medians.select(*cols).first()
    return derive_features(repair_vitals(raw).withColumns({c: F.coalesce(F.col(c), F.lit(med[c]).cast("double")) for c in cols}))


def running_outcome_rate(df: DataFrame, keys, outcome: str = C.OUTCOME) -> DataFrame:
    """D1 as a streaming aggregate (complete/update output modes): the batch operator on a stream."""
    return outcome_rate(df, keys, outcome)
