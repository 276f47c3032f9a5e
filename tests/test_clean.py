"""Cleaning and feature traps (T2-T12, Q12, B1-B15) on literal rows."""

import math

from pyspark.sql import functions as F

from flipwise import config as C
from flipwise.operators import clean as CL
from flipwise.operators import features as FE
from flipwise.plans.encounters import cleaned
from flipwise.sources.tables import nan_to_null, tokens_to_null

RAW_SCHEMA = ("encounter_id bigint, DRG01 int, Age double, Gender string, PrimaryInsuranceCategory string,"
              " BloodPressureUpper double, BloodPressureLower double, BloodPressureDiff string,"
              " Pulse double, PulseOximetry double, Respirations double, Temperature double,"
              " Flipped int, OU_LOS_hrs double")


def raw_rows(spark):
    rows = [
        # id, drg, age, gender, ins, up, low, diff, pulse, spo2, resp, temp, y, los
        (1, 428, 40.0, "Male", "MEDICARE", 150.0, 80.0, "70", 110.0, 91.0, 22.0, 101.0, 1, 30.0),
        (2, 999, 0.0, None, None, None, 0.0, "#VALUE!", None, None, 73.0, None, 0, 10.0),
        (3, 276, 89.0, "Female", "Private", 120.0, 0.0, "#VALUE!", 80.0, 97.0, 16.0, 98.0, 0, 12.0),
        (4, 786, 90.0, "Female", "MEDICAID STATE", 85.0, 60.0, None, 70.0, 95.0, 20.0, 100.4, 1, 40.0),
        (5, 578, None, "Male", "BOGUS", 130.0, 70.0, "60", 100.0, 92.0, 18.0, 99.0, 0, 20.0),
    ]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def by_id(df):
    return {r["encounter_id"]: r for r in df.collect()}


def test_repair_order_and_quirks(spark):
    r = by_id(CL.repair_vitals(raw_rows(spark)))
    # T5/B1: '#VALUE!' -> NULL; B2 recomputes before B3, so Lower = 0 gives Diff = Upper (Q12)
    assert r[3]["BloodPressureDiff"] == 120.0 and r[3]["BloodPressureLower"] is None
    # Upper NULL and Lower (0 -> NULL) -> Diff NULL
    assert r[2]["BloodPressureDiff"] is None and r[2]["BloodPressureLower"] is None
    # Impossible respiration -> NULL
    assert r[2]["Respirations"] is None
    # missing text stays missing, recomputed from parts
    assert r[4]["BloodPressureDiff"] == 25.0


def test_exact_median_imputation(spark):
    out = by_id(CL.clean_vitals(raw_rows(spark)))
    # Pulse values 110, 80, 70, 100 -> exact median 90 (mean of the two middle ones)
    assert out[2]["Pulse"] == 90.0
    # Upper 150, 120, 85, 130 -> 125
    assert out[2]["BloodPressureUpper"] == 125.0
    assert all(out[i]["PulseOximetry"] is not None for i in out)


def test_features_and_null_rules(spark):
    d = by_id(cleaned(raw_rows(spark)))
    assert d[1]["DiagnosisName"] == "Congestive Heart Failure"
    assert d[2]["DiagnosisName"] is None          # T3 unmapped code
    assert d[5]["InsuranceGroup"] is None         # T3 unmapped category
    assert d[4]["InsuranceGroup"] == "Medicaid"
    # T8 right-closed bins: 40 in first bin, 0 and 90 outside, 89 in last
    assert d[1]["AgeGroup"] == "18–40"
    assert d[2]["AgeGroup"] is None and d[4]["AgeGroup"] is None
    assert d[3]["AgeGroup"] == "76+" and d[5]["AgeGroup"] is None
    # B11 strict thresholds; T2 NULL -> 0
    assert d[1]["Flag_Tachycardia"] == 1 and d[5]["Flag_Tachycardia"] == 0
    assert d[4]["Flag_Fever"] == 0 and d[1]["Flag_Fever"] == 1
    assert d[5]["Flag_Hypo_O2"] == 0 and d[1]["Flag_Hypo_O2"] == 1
    assert d[4]["Flag_Hypotension"] == 1 and d[1]["Flag_Hypertension"] == 1
    assert d[1]["AbnormalVitalCount"] == 5
    # B13 / B14 with NULL -> 0
    assert d[1]["OnExpandedExclusionList"] == 1 and d[3]["OnExpandedExclusionList"] == 0
    assert d[2]["GenderBinary"] == 0 and d[1]["GenderBinary"] == 1


def test_one_hot_drops_first_sorted_level(spark):
    d = cleaned(raw_rows(spark))
    out, names = FE.one_hot(d, C.INSURANCE, "Ins")
    assert names == ["Ins_Medicare", "Ins_Private"]      # Medicaid (first sorted) dropped
    rows = by_id(out)
    assert (rows[5]["Ins_Medicare"], rows[5]["Ins_Private"]) == (0.0, 0.0)  # NULL -> all zeros
    assert rows[1]["Ins_Medicare"] == 1.0


def test_nan_and_token_loading(spark):
    df = spark.createDataFrame([(float("nan"), "NA"), (1.0, "x"), (2.0, "")], "v double, s string")
    r = nan_to_null(tokens_to_null(df)).collect()
    assert r[0]["v"] is None and r[0]["s"] is None and r[2]["s"] is None and r[1]["s"] == "x"


def test_null_profile_counts(spark):
    prof = {r["column"]: r["n_null"] for r in CL.null_profile(raw_rows(spark)).collect()}
    assert prof["Pulse"] == 1 and prof["Age"] == 1 and prof["Gender"] == 1 and prof["encounter_id"] == 0


def test_approx_median_option(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    ex = CL.median_row(df, ["x"], "exact").first()["x"]
    ap = CL.median_row(df, ["x"], "approx").first()["x"]
    assert ex == 500.0 and math.isclose(ap, 500.0, abs_tol=2.0)
