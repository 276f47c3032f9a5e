"""Queries for cleaning, features, profiling and cohorts, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import clean as CL
from ..operators import cohort as CO
from ..operators import features as FE
from ..operators import profile as PR
from ..sources.fixtures import raw_encounters
from ..sources.tables import shape
from . import oracle as O
from .encounters import cleaned_encounters

PROFILE_QUERIES = {}
PROFILE_SQL = {}


def register(name, sql=None):
    def deco(fn):
        PROFILE_QUERIES[name] = fn
        if sql is not None:
            PROFILE_SQL[name] = sql
        return fn
    return deco


def _rate_sql(keys: list[str], source: str = "clean", where: str = "") -> str:
    k = ", ".join(keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    cond = f"{nn} AND ({where})" if where else nn
    return (f"SELECT {k}, CAST(SUM(Flipped) AS BIGINT) AS Flipped_Count, COUNT(Flipped) AS Total,"
            f" CAST(SUM(Flipped) AS DOUBLE) / COUNT(Flipped) AS Flip_Rate,"
            f" {O.pct_sql('CAST(SUM(Flipped) AS DOUBLE) / COUNT(Flipped)')} AS Flip_Pct"
            f" FROM {source} WHERE {cond} GROUP BY {k}")


# ---------------------------------------------------------------- step 0 / 1

@register("flip_rate_by_diagnosis", O.with_clean(_rate_sql([C.DIAGNOSIS])))
def q_flip_rate_by_diagnosis(spark, sf_dir):
    return PR.outcome_rate(cleaned_encounters(spark, sf_dir), C.DIAGNOSIS).orderBy("Flip_Rate", C.DIAGNOSIS)


@register("clean_encounters", O.with_clean("SELECT * FROM clean"))
def q_clean_encounters(spark, sf_dir):
    return cleaned_encounters(spark, sf_dir)


_RAW_COLS = ["encounter_id", "DRG01", "Age", "Gender", "PrimaryInsuranceCategory",
             "BloodPressureUpper", "BloodPressureLower", "BloodPressureDiff", "Pulse",
             "PulseOximetry", "Respirations", "Temperature", "Flipped", "OU_LOS_hrs"]


@register("null_profile", O.with_raw(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null, {i} AS position FROM raw"
    for i, c in enumerate(_RAW_COLS))))
def q_null_profile(spark, sf_dir):
    return CL.null_profile(raw_encounters(spark, sf_dir))


@register("impute_medians", O.with_clean(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT COUNT(*) FROM rep WHERE {c} IS NULL) AS n_missing,"
    f" (SELECT m_{c} FROM med) AS median"
    for c in C.IMPUTED_VITALS)))
def q_impute_medians(spark, sf_dir):
    return CL.imputation_report(raw_encounters(spark, sf_dir))


_CLEAN_COLS = _RAW_COLS + ["DiagnosisName", "InsuranceGroup", "AgeGroup"] + C.FLAG_COLUMNS + [
    "AbnormalVitalCount", "OnExpandedExclusionList", "GenderBinary"]


@register("cleaning_report", O.with_clean(
    "SELECT n_rows, n_diff_recomputed, n_lower_zero, n_resp_screened, n_columns, n_missing_remaining FROM "
    "(SELECT COUNT(*) AS n_rows,"
    " COUNT(*) FILTER (WHERE TRY_CAST(BloodPressureDiff AS DOUBLE) IS NULL) AS n_diff_recomputed,"
    " COUNT(*) FILTER (WHERE BloodPressureLower = 0) AS n_lower_zero,"
    " COUNT(*) FILTER (WHERE Respirations > 60) AS n_resp_screened,"
    f" CAST({len(_RAW_COLS)} AS BIGINT) AS n_columns FROM raw) a CROSS JOIN "
    "(SELECT CAST(SUM(" + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _CLEAN_COLS)
    + ") AS BIGINT) AS n_missing_remaining FROM clean) b"))
def q_cleaning_report(spark, sf_dir):
    return CL.cleaning_report(raw_encounters(spark, sf_dir), cleaned_encounters(spark, sf_dir))


@register("table_shape", O.with_raw(
    f"SELECT COUNT(*) AS n_rows, CAST({len(_RAW_COLS)} AS BIGINT) AS n_columns FROM raw"))
def q_table_shape(spark, sf_dir):
    return shape(raw_encounters(spark, sf_dir))


@register("age_groups", O.with_clean(
    "SELECT encounter_id, Age, AgeGroup, CASE " + " ".join(
        f"WHEN Age > {lo} AND Age <= {hi} THEN {i}"
        for i, (lo, hi) in enumerate([(0, 40), (40, 55), (55, 65), (65, 75), (75, 89)]))
    + " ELSE NULL END AS age_group_ord FROM clean"))
def q_age_groups(spark, sf_dir):
    d = FE.add_age_group(cleaned_encounters(spark, sf_dir).drop(C.AGE_GROUP),
                         ordinal=C.AGE_GROUP_ORD)
    return d.select(C.ID, C.AGE, C.AGE_GROUP, C.AGE_GROUP_ORD)


@register("vital_flags", O.with_clean(
    "SELECT encounter_id, " + ", ".join(C.FLAG_COLUMNS)
    + ", AbnormalVitalCount, OnExpandedExclusionList, GenderBinary FROM clean"))
def q_vital_flags(spark, sf_dir):
    return cleaned_encounters(spark, sf_dir).select(
        C.ID, *C.FLAG_COLUMNS, C.ABNORMAL_COUNT, C.EXCLUSION_FLAG, C.GENDER_BINARY)


@register("insurance_group", O.with_clean(
    "SELECT encounter_id, PrimaryInsuranceCategory, InsuranceGroup, DRG01, DiagnosisName FROM clean"))
def q_insurance_group(spark, sf_dir):
    return cleaned_encounters(spark, sf_dir).select(
        C.ID, C.INSURANCE_RAW, C.INSURANCE, C.CODE, C.DIAGNOSIS)


# One-hot levels observed in the fixture (sorted, first dropped).
_INS_KEPT = ["Medicare", "Private"]
_CODE_KEPT = sorted(C.DRG_NAMES)[1:] + [999]


@register("one_hot_features", O.with_clean(
    "SELECT encounter_id, Flipped, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.BASE_FEATURES)
    + ", " + ", ".join(f"CAST(COALESCE(InsuranceGroup = '{v}', FALSE) AS DOUBLE) AS Ins_{v}" for v in _INS_KEPT)
    + ", " + ", ".join(f"CAST(COALESCE(DRG01 = {v}, FALSE) AS DOUBLE) AS DRG_{v}" for v in _CODE_KEPT)
    + " FROM clean"))
def q_one_hot_features(spark, sf_dir):
    d, feats = FE.model_features(cleaned_encounters(spark, sf_dir))
    return d.select(C.ID, C.OUTCOME, *feats)


# ---------------------------------------------------------------- step 2

@register("flip_rate_by_insurance", O.with_clean(_rate_sql([C.INSURANCE])))
def q_flip_rate_by_insurance(spark, sf_dir):
    return PR.outcome_rate(cleaned_encounters(spark, sf_dir), C.INSURANCE)


@register("flip_rate_by_gender", O.with_clean(_rate_sql([C.GENDER])))
def q_flip_rate_by_gender(spark, sf_dir):
    return PR.outcome_rate(cleaned_encounters(spark, sf_dir), C.GENDER)


@register("flip_rate_by_abnormal_count", O.with_clean(_rate_sql([C.ABNORMAL_COUNT])))
def q_flip_rate_by_abnormal_count(spark, sf_dir):
    return PR.outcome_rate(cleaned_encounters(spark, sf_dir), C.ABNORMAL_COUNT).orderBy(C.ABNORMAL_COUNT)


@register("flip_rate_by_diagnosis_age", O.with_clean(_rate_sql([C.DIAGNOSIS, C.AGE_GROUP])))
def q_flip_rate_by_diagnosis_age(spark, sf_dir):
    return PR.outcome_rate(cleaned_encounters(spark, sf_dir), [C.DIAGNOSIS, C.AGE_GROUP])


_OVERALL_SQL = ("overall AS (SELECT CAST(SUM(Flipped) AS DOUBLE) / COUNT(Flipped) AS Overall_Rate,"
                f" {O.pct_sql('CAST(SUM(Flipped) AS DOUBLE) / COUNT(Flipped)')} AS Overall_Pct FROM clean),"
                f" rates AS ({_rate_sql([C.DIAGNOSIS])})")


@register("volume_and_rate", O.with_clean("SELECT * FROM rates CROSS JOIN overall", _OVERALL_SQL))
def q_volume_and_rate(spark, sf_dir):
    df = cleaned_encounters(spark, sf_dir)
    return PR.with_overall_rate(PR.outcome_rate(df, C.DIAGNOSIS), df).orderBy(
        F.col("Total").desc(), C.DIAGNOSIS)


_SEV = "CASE WHEN Flip_Pct > 60 THEN 'High' WHEN Flip_Pct > 45 THEN 'Medium' ELSE 'Low' END"


@register("diagnosis_severity", O.with_clean(f"SELECT *, {_SEV} AS Severity FROM rates", _OVERALL_SQL))
def q_diagnosis_severity(spark, sf_dir):
    return PR.band_rates(PR.outcome_rate(cleaned_encounters(spark, sf_dir), C.DIAGNOSIS))


@register("kpi_summary", O.with_clean(
    "SELECT COUNT(*) AS n_total, CAST(SUM(Flipped) AS BIGINT) AS n_flipped,"
    " CAST(SUM(Flipped) AS DOUBLE) / COUNT(Flipped) AS flip_rate,"
    f" {O.pct_sql('CAST(SUM(Flipped) AS DOUBLE) / COUNT(Flipped)')} AS flip_pct,"
    " COUNT(*) FILTER (WHERE Flipped = 0) AS n_stayed,"
    f" {O.pct_sql('CAST(COUNT(*) FILTER (WHERE Flipped = 0) AS DOUBLE) / COUNT(*)')} AS stayed_pct,"
    " AVG(OU_LOS_hrs) AS los_mean_all,"
    " AVG(CASE WHEN Flipped = 1 THEN OU_LOS_hrs END) AS los_mean_flipped,"
    " AVG(CASE WHEN Flipped = 0 THEN OU_LOS_hrs END) AS los_mean_stayed,"
    " AVG(Age) AS age_mean FROM clean"))
def q_kpi_summary(spark, sf_dir):
    return PR.kpi_summary(cleaned_encounters(spark, sf_dir))


_HEAT_CTE = ("cells AS (SELECT DiagnosisName, AgeGroup, SUM(Flipped) AS s, COUNT(Flipped) AS n FROM clean"
             " WHERE DiagnosisName IS NOT NULL AND AgeGroup IS NOT NULL GROUP BY 1, 2),"
             " rk AS (SELECT DISTINCT DiagnosisName FROM cells), ck AS (SELECT DISTINCT AgeGroup FROM cells)")


@register("heatmap_diag_age", O.with_clean(
    "SELECT rk.DiagnosisName, ck.AgeGroup,"
    f" COALESCE({O.pct_sql('CAST(cells.s AS DOUBLE) / cells.n')}, 0.0) AS Flip_Pct"
    " FROM rk CROSS JOIN ck LEFT JOIN cells ON cells.DiagnosisName = rk.DiagnosisName"
    " AND cells.AgeGroup = ck.AgeGroup", _HEAT_CTE))
def q_heatmap_diag_age(spark, sf_dir):
    return PR.rate_heatmap(cleaned_encounters(spark, sf_dir))


@register("heatmap_wide", O.with_clean(
    "SELECT DiagnosisName, " + ", ".join(
        f"COALESCE({O.pct_sql(f'CAST(SUM(CASE WHEN AgeGroup = {O._q(lv)} THEN Flipped END) AS DOUBLE) / NULLIF(COUNT(CASE WHEN AgeGroup = {O._q(lv)} THEN Flipped END), 0)')}, 0.0) AS \"{lv}\""
        for lv in C.AGE_LABELS)
    + " FROM clean WHERE DiagnosisName IS NOT NULL AND AgeGroup IS NOT NULL GROUP BY DiagnosisName"))
def q_heatmap_wide(spark, sf_dir):
    return PR.rate_heatmap_wide(cleaned_encounters(spark, sf_dir))


def _by_outcome_cte(cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts += [f"AVG(CASE WHEN Flipped = 0 THEN {c} END) AS s{i}",
                  f"AVG(CASE WHEN Flipped = 1 THEN {c} END) AS f{i}",
                  f"MIN({c}) AS lo{i}", f"MAX({c}) AS hi{i}"]
    return "a AS (SELECT " + ", ".join(parts) + " FROM clean)"


def _vitals_norm_sql() -> str:
    sel = []
    for i, (c, lab) in enumerate(zip(C.PROFILE_VITALS, C.PROFILE_VITAL_LABELS)):
        sel.append(
            f"SELECT {i} AS position, '{c}' AS measure, '{lab}' AS label, s{i} AS stayed_mean,"
            f" f{i} AS flipped_mean, lo{i} AS min, hi{i} AS max,"
            f" {O.pct_sql(f'(s{i} - lo{i}) / NULLIF(hi{i} - lo{i}, 0)')} AS stayed_norm,"
            f" {O.pct_sql(f'(f{i} - lo{i}) / NULLIF(hi{i} - lo{i}, 0)')} AS flipped_norm FROM a")
    return " UNION ALL ".join(sel)


@register("vitals_normalised", O.with_clean(_vitals_norm_sql(), _by_outcome_cte(C.PROFILE_VITALS)))
def q_vitals_normalised(spark, sf_dir):
    return PR.vitals_normalised(cleaned_encounters(spark, sf_dir))


def _vitals_cmp_sql(mode: str) -> str:
    sel = []
    for i, (c, lab) in enumerate(zip(C.PROFILE_VITALS, C.PROFILE_VITAL_LABELS)):
        sr, fr = O.r1_sql(f"s{i}"), O.r1_sql(f"f{i}")
        d = O.r1_sql(f"f{i} - s{i}") if mode == "raw" else O.r1_sql(f"{fr} - {sr}")
        sel.append(
            f"SELECT {i} AS position, '{c}' AS measure, '{lab}' AS label, {sr} AS stayed_mean,"
            f" {fr} AS flipped_mean, {d} AS difference,"
            f" CASE WHEN {d} > 0 THEN '↑' ELSE '↓' END AS direction, ABS({d}) AS abs_difference,"
            f" LEAST({fr} / NULLIF(hi{i}, 0) * 100.0, 100.0) AS pct_of_max FROM a")
    return " UNION ALL ".join(sel)


@register("vitals_compare", O.with_clean(_vitals_cmp_sql("raw"), _by_outcome_cte(C.PROFILE_VITALS)))
def q_vitals_compare(spark, sf_dir):
    return PR.vitals_compare(cleaned_encounters(spark, sf_dir), diff="raw")


@register("vitals_compare_rounded", O.with_clean(_vitals_cmp_sql("rounded"),
                                                 _by_outcome_cte(C.PROFILE_VITALS)))
def q_vitals_compare_rounded(spark, sf_dir):
    return PR.vitals_compare(cleaned_encounters(spark, sf_dir), diff="rounded")


def _flag_sql() -> str:
    sel = []
    for i, (fl, lab) in enumerate(zip(C.FLAG_COLUMNS, C.FLAG_LABELS)):
        sel.append(f"SELECT {i} AS position, '{fl}' AS flag, '{lab}' AS label,"
                   f" {O.pct_sql(f's{i}')} AS stayed_pct, {O.pct_sql(f'f{i}')} AS flipped_pct FROM a")
    return " UNION ALL ".join(sel)


@register("flag_prevalence", O.with_clean(_flag_sql(), _by_outcome_cte(C.FLAG_COLUMNS)))
def q_flag_prevalence(spark, sf_dir):
    return PR.flag_prevalence(cleaned_encounters(spark, sf_dir))


@register("los_median_order", O.with_clean(
    "SELECT DiagnosisName, median(OU_LOS_hrs) AS median,"
    " CAST(row_number() OVER (ORDER BY median(OU_LOS_hrs) DESC, DiagnosisName) AS INTEGER) AS \"order\""
    " FROM clean WHERE DiagnosisName IS NOT NULL GROUP BY DiagnosisName"))
def q_los_median_order(spark, sf_dir):
    return PR.median_order(cleaned_encounters(spark, sf_dir)).orderBy("order")


@register("value_counts", O.with_clean(
    "SELECT InsuranceGroup, COUNT(*) AS count FROM clean WHERE InsuranceGroup IS NOT NULL GROUP BY 1"))
def q_value_counts(spark, sf_dir):
    return PR.value_counts(cleaned_encounters(spark, sf_dir), C.INSURANCE).orderBy(F.col("count").desc())


# ---------------------------------------------------------------- step 3 (cohorts)

COHORT = dict(in_sets={C.INSURANCE: ["Medicare", "Private"], C.GENDER: ["Female"]},
              ranges={C.AGE: (30, 75)})
_COHORT_WHERE = ("InsuranceGroup IN ('Medicare', 'Private') AND Gender IN ('Female')"
                 " AND Age >= 30 AND Age <= 75")


@register("cohort_filtered_rates", O.with_clean(_rate_sql([C.INSURANCE], where=_COHORT_WHERE)))
def q_cohort_filtered_rates(spark, sf_dir):
    return PR.outcome_rate(CO.cohort_filter(cleaned_encounters(spark, sf_dir), **COHORT), C.INSURANCE)


@register("cohort_with_null_option", O.with_clean(_rate_sql(
    [C.GENDER], where="(DiagnosisName IN ('Pneumonia', 'Syncope') OR DiagnosisName IS NULL)"
                      " AND Age >= 19 AND Age <= 89")))
def q_cohort_with_null_option(spark, sf_dir):
    df = CO.cohort_filter(cleaned_encounters(spark, sf_dir),
                          in_sets={C.DIAGNOSIS: ["Pneumonia", "Syncope", None]},
                          ranges={C.AGE: (19, 89)})
    return PR.outcome_rate(df, C.GENDER)


@register("diagnosis_filter", O.with_clean(
    "SELECT Flipped, COUNT(*) AS n, AVG(OU_LOS_hrs) AS los_mean FROM clean"
    " WHERE DiagnosisName = 'Chest Pain' GROUP BY Flipped"))
def q_diagnosis_filter(spark, sf_dir):
    df = CO.key_filter(cleaned_encounters(spark, sf_dir), C.DIAGNOSIS, "Chest Pain")
    return df.groupBy(C.OUTCOME).agg(F.count(F.lit(1)).alias("n"), F.avg(C.LOS).alias("los_mean"))


@register("option_lists", O.with_clean(
    "SELECT DISTINCT 'InsuranceGroup' AS \"column\", CAST(InsuranceGroup AS VARCHAR) AS value FROM clean"
    " UNION ALL SELECT DISTINCT 'DiagnosisName' AS \"column\", DiagnosisName AS value FROM clean"
    " WHERE DiagnosisName IS NOT NULL"))
def q_option_lists(spark, sf_dir):
    return CO.option_lists(cleaned_encounters(spark, sf_dir), [C.INSURANCE, C.DIAGNOSIS],
                           keep_null={C.INSURANCE: True}).orderBy("column", "value")
