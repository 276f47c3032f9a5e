"""Sources and sinks (A1, A2, A5) and the streaming profile."""

import os
import tempfile

from pyspark.sql import functions as F

from flipwise import config as C
from flipwise.operators import clean as CL
from flipwise.operators import features as FE
from flipwise.operators import profile as PR
from flipwise.plans.encounters import cleaned
from flipwise.sources.fixtures import raw_encounters
from flipwise.sources.tables import read_csv, write_table
from flipwise.streaming.incremental import clean_stream, encounter_stream, running_outcome_rate


def test_csv_round_trip_and_rederive(spark, sf_small):
    out = tempfile.mkdtemp(prefix="flipwise-io-")
    raw = raw_encounters(spark, sf_small)
    write_table(raw, os.path.join(out, "raw_csv"), fmt="csv")
    back = read_csv(spark, os.path.join(out, "raw_csv"), raw.schema)
    assert back.count() == raw.count()
    assert back.where(F.col(C.BP_DIFF) == "#VALUE!").count() == raw.where(F.col(C.BP_DIFF) == "#VALUE!").count()
    clean = cleaned(raw)
    write_table(clean, os.path.join(out, "clean_pq"), partition_by=[C.DIAGNOSIS])
    again = FE.rederive_keys(spark.read.parquet(os.path.join(out, "clean_pq")))
    a = PR.outcome_rate(again, C.DIAGNOSIS).select(C.DIAGNOSIS, "Total")
    b = PR.outcome_rate(clean, C.DIAGNOSIS).select(C.DIAGNOSIS, "Total")
    assert a.exceptAll(b).count() == 0


def test_streaming_rate_equals_batch(spark, sf_small):
    folder = tempfile.mkdtemp(prefix="flipwise-stream-")
    raw = raw_encounters(spark, sf_small)
    for i in range(3):
        raw.where(F.col(C.ID) % 3 == i).write.mode("overwrite").parquet(os.path.join(folder, f"part{i}"))
    medians = CL.median_row(CL.repair_vitals(raw), C.IMPUTED_VITALS)
    stream = encounter_stream(spark, os.path.join(folder, "*"), raw.schema, max_files_per_trigger=1)
    agg = running_outcome_rate(clean_stream(stream, medians), C.DIAGNOSIS)
    q = agg.writeStream.outputMode("complete").format("memory").queryName("rates_stream") \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="flipwise-sck-")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM rates_stream")
    ref = PR.outcome_rate(cleaned(raw), C.DIAGNOSIS)
    assert got.select(*ref.columns).exceptAll(ref).count() == 0
