"""Independent SQL statements of each checked query, for DuckDB.

They are written against the driver's raw tables only (pre-registered views)
and re-derive everything in plain SQL: the fixture view (FIXTURES.md section
4, verbatim), the cleaning steps, features and every statistic.  Thresholds
and bin edges are written out as literals; only the text lists (names, groups)
come from ``config``.
"""

from __future__ import annotations

from .. import config as C


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FIXTURE_SQL = """
li AS (
  SELECT l_orderkey, MAX(l_quantity) AS q_max, MIN(l_quantity) AS q_min, COUNT(*) AS n_lines
  FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderstatus AS st, c.c_mktsegment AS seg,
         li.q_max, li.q_min, li.n_lines,
         CASE o.o_orderkey % 13 WHEN 0 THEN 276 WHEN 1 THEN 428 WHEN 2 THEN 486 WHEN 3 THEN 558
           WHEN 4 THEN 577 WHEN 5 THEN 578 WHEN 6 THEN 599 WHEN 7 THEN 780 WHEN 8 THEN 782
           WHEN 9 THEN 786 WHEN 10 THEN 787 WHEN 11 THEN 789 ELSE 999 END AS drg
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
raw AS (
SELECT k AS encounter_id, drg AS DRG01,
  CAST(CASE WHEN k % 211 = 0 THEN NULL ELSE 19 + ck % 71 END AS DOUBLE) AS Age,
  CASE WHEN ck % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
  CASE seg WHEN 'AUTOMOBILE' THEN 'MEDICARE' WHEN 'BUILDING' THEN 'MEDICARE OTHER'
    WHEN 'FURNITURE' THEN 'MEDICAID STATE' WHEN 'HOUSEHOLD' THEN 'MEDICAID OTHER'
    ELSE 'Private' END AS PrimaryInsuranceCategory,
  CAST(80 + 2 * q_max AS DOUBLE) AS BloodPressureUpper,
  CAST(CASE WHEN q_min IS NULL THEN 0 ELSE 40 + q_min END AS DOUBLE) AS BloodPressureLower,
  CASE WHEN q_max IS NULL OR k % 97 = 0 THEN '#VALUE!'
    ELSE CAST(CAST(40 + 2 * q_max - q_min AS BIGINT) AS VARCHAR(20)) END AS BloodPressureDiff,
  CAST(CASE WHEN k % 53 = 0 THEN NULL ELSE 50 + (k * 7) % 70 END AS DOUBLE) AS Pulse,
  CAST(CASE WHEN k % 59 = 0 THEN NULL ELSE 85 + (k * 11) % 16 END AS DOUBLE) AS PulseOximetry,
  CAST(CASE WHEN k % 499 = 0 THEN 73 ELSE 10 + (ck * 3) % 16 END AS DOUBLE) AS Respirations,
  CAST(CASE WHEN k % 61 = 0 THEN NULL ELSE 96 + (k * 13) % 8 END AS DOUBLE) AS Temperature,
  CASE WHEN st = 'F' OR (st = 'P' AND drg IN (428, 486, 577, 578)) THEN 1 ELSE 0 END AS Flipped,
  CAST(COALESCE(q_max, 10) + CASE WHEN st = 'F' THEN 24 ELSE 0 END AS DOUBLE) AS OU_LOS_hrs
FROM b)"""


def _case_map(col: str, mapping: dict, quote_key: bool) -> str:
    whens = " ".join(
        f"WHEN {_q(k) if quote_key else k} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE NULL END"


def _age_case(col: str = "Age") -> str:
    return (f"CASE WHEN {col} > 0 AND {col} <= 40 THEN '18–40' WHEN {col} > 40 AND {col} <= 55 THEN '41–55'"
            f" WHEN {col} > 55 AND {col} <= 65 THEN '56–65' WHEN {col} > 65 AND {col} <= 75 THEN '66–75'"
            f" WHEN {col} > 75 AND {col} <= 89 THEN '76+' ELSE NULL END")


_VITALS = C.IMPUTED_VITALS
# Limits are written out here, not taken from the code under test.
_FLAGS = {"Flag_Tachycardia": "Pulse > 100", "Flag_Hypo_O2": "PulseOximetry < 92", "Flag_Fever": "Temperature > 100.4",
          "Flag_Tachypnea": "Respirations > 20", "Flag_Hypertension": "BloodPressureUpper > 140",
          "Flag_Hypotension": "BloodPressureUpper < 90"}
_FLAG_SQL = ",\n    ".join(f"CAST(COALESCE({rule}, FALSE) AS INTEGER) AS {name}" for name, rule in _FLAGS.items())
_FLAG_SUM = " + ".join(f"CAST(COALESCE({rule}, FALSE) AS INTEGER)" for rule in _FLAGS.values())
_EXCL = "428, 486, 577, 578"

CLEAN_SQL = f"""
rep AS (
  SELECT encounter_id, DRG01, Age, Gender, PrimaryInsuranceCategory, BloodPressureUpper,
    CASE WHEN BloodPressureLower = 0 THEN NULL ELSE BloodPressureLower END AS BloodPressureLower,
    CASE WHEN BloodPressureUpper IS NULL AND (BloodPressureLower IS NULL OR BloodPressureLower = 0)
         THEN NULL
         ELSE COALESCE(TRY_CAST(BloodPressureDiff AS DOUBLE), BloodPressureUpper - BloodPressureLower)
    END AS BloodPressureDiff,
    Pulse, PulseOximetry,
    CASE WHEN Respirations > 60 THEN NULL ELSE Respirations END AS Respirations,
    Temperature, Flipped, OU_LOS_hrs
  FROM raw),
med AS (
  SELECT {", ".join(f"median({v}) AS m_{v}" for v in _VITALS)} FROM rep),
cv AS (
  SELECT encounter_id, DRG01, Age, Gender, PrimaryInsuranceCategory,
    {", ".join(f"COALESCE({v}, m_{v}) AS {v}" for v in _VITALS)},
    Flipped, OU_LOS_hrs
  FROM rep CROSS JOIN med),
clean AS (
  SELECT encounter_id, DRG01, Age, Gender, PrimaryInsuranceCategory,
    BloodPressureUpper, BloodPressureLower, BloodPressureDiff, Pulse, PulseOximetry,
    Respirations, Temperature, Flipped, OU_LOS_hrs,
    {_case_map("DRG01", C.DRG_NAMES, False)} AS DiagnosisName,
    {_case_map("PrimaryInsuranceCategory", C.INSURANCE_GROUPS, True)} AS InsuranceGroup,
    {_age_case()} AS AgeGroup,
    {_FLAG_SQL},
    {_FLAG_SUM} AS AbnormalVitalCount,
    CAST(COALESCE(DRG01 IN ({_EXCL}), FALSE) AS INTEGER) AS OnExpandedExclusionList,
    CAST(COALESCE(Gender = 'Male', FALSE) AS INTEGER) AS GenderBinary
  FROM cv)"""


def with_clean(select: str, extra_ctes: str = "") -> str:
    """Full statement: fixture + cleaning CTEs, optional extra CTEs, final SELECT."""
    extra = (",\n" + extra_ctes.strip().rstrip(",")) if extra_ctes.strip() else ""
    return f"WITH {FIXTURE_SQL.strip()},\n{CLEAN_SQL.strip()}{extra}\n{select.strip()}"


def with_raw(select: str, extra_ctes: str = "") -> str:
    extra = (",\n" + extra_ctes.strip().rstrip(",")) if extra_ctes.strip() else ""
    return f"WITH {FIXTURE_SQL.strip()}{extra}\n{select.strip()}"


def pct_sql(expr: str) -> str:
    """``(x * 100).round(1)`` as half-even rounding of the scaled double."""
    return f"(round_even(({expr}) * 100.0 * 10.0, 0) / 10.0)"


def r1_sql(expr: str) -> str:
    return f"(round_even(({expr}) * 10.0, 0) / 10.0)"


def fixed_sql(expr: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(round_even(({expr}) * {scale!r}, 0) / {scale!r})"
