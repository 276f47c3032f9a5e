"""Domain constants and default column names.

Everything that has to equal the analysed pipeline's own values lives here,
in one place, so the operators themselves stay schema-agnostic: every operator
takes column names and rule tables as parameters and only defaults to these.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: these must equal the values of the analysed pipeline for the
# results to match (code lists, label texts, thresholds, bins, constants).
# --------------------------------------------------------------------------

# Diagnosis-related-group code -> diagnosis name (12 codes).
DRG_NAMES: dict[int, str] = {
    276: "Dehydration",
    428: "Congestive Heart Failure",
    486: "Pneumonia",
    558: "Colitis",
    577: "Pancreatitis",
    578: "GI Bleeding",
    599: "Urinary Tract Infection",
    780: "Syncope",
    782: "Edema",
    786: "Chest Pain",
    787: "Nausea",
    789: "Abdominal Pain",
}

# Raw insurance category -> consolidated group (5 -> 3).
INSURANCE_GROUPS: dict[str, str] = {
    "MEDICARE": "Medicare",
    "MEDICARE OTHER": "Medicare",
    "MEDICAID STATE": "Medicaid",
    "MEDICAID OTHER": "Medicaid",
    "Private": "Private",
}

# Right-closed age bins (0,40], (40,55], (55,65], (65,75], (75,89] and labels
# (en-dash in the labels).
AGE_EDGES: list[float] = [0, 40, 55, 65, 75, 89]
AGE_LABELS: list[str] = ["18–40", "41–55", "56–65", "66–75", "76+"]

# Abnormal-vital rules: (flag column, measure column, operator, threshold).
# Strict comparisons; a missing measure gives flag 0.
VITAL_FLAG_RULES: list[tuple[str, str, str, float]] = [
    ("Flag_Tachycardia", "Pulse", ">", 100.0),
    ("Flag_Hypo_O2", "PulseOximetry", "<", 92.0),
    ("Flag_Fever", "Temperature", ">", 100.4),
    ("Flag_Tachypnea", "Respirations", ">", 20.0),
    ("Flag_Hypertension", "BloodPressureUpper", ">", 140.0),
    ("Flag_Hypotension", "BloodPressureUpper", "<", 90.0),
]

# Diagnosis codes on the expanded exclusion list.
EXCLUSION_CODES: list[int] = [428, 486, 577, 578]

# Impossible-value screens: measure above the bound becomes missing.
UPPER_BOUNDS: dict[str, float] = {"Respirations": 60.0}

# Vitals imputed with their exact median, in this order.
IMPUTED_VITALS: list[str] = [
    "BloodPressureUpper", "BloodPressureLower", "BloodPressureDiff",
    "Pulse", "PulseOximetry", "Respirations", "Temperature",
]

# Vitals compared between outcomes, with display labels.
PROFILE_VITALS: list[str] = [
    "BloodPressureUpper", "BloodPressureLower", "Pulse",
    "PulseOximetry", "Respirations", "Temperature",
]
PROFILE_VITAL_LABELS: list[str] = [
    "Systolic BP", "Diastolic BP", "Pulse",
    "Pulse Oximetry", "Respirations", "Temperature",
]

FLAG_COLUMNS: list[str] = [r[0] for r in VITAL_FLAG_RULES]
FLAG_LABELS: list[str] = ["Tachycardia", "Low O2", "Fever", "Tachypnea",
                          "Hypertension", "Hypotension"]

# Base model features (before one-hot columns are appended).
BASE_FEATURES: list[str] = [
    "Age", "GenderBinary", "BloodPressureUpper", "BloodPressureLower",
    "BloodPressureDiff", "Pulse", "PulseOximetry", "Respirations",
    "Temperature", "AbnormalVitalCount", "Flag_Tachycardia", "Flag_Hypo_O2",
    "Flag_Fever", "Flag_Tachypnea", "Flag_Hypertension", "Flag_Hypotension",
]

# Display names of model features.
FEATURE_LABELS: dict[str, str] = {
    "Age": "Patient Age",
    "GenderBinary": "Gender (Male)",
    "BloodPressureUpper": "Systolic BP",
    "BloodPressureLower": "Diastolic BP",
    "BloodPressureDiff": "Pulse Pressure",
    "Pulse": "Heart Rate",
    "PulseOximetry": "O₂ Saturation",
    "Respirations": "Respiratory Rate",
    "Temperature": "Temperature",
    "AbnormalVitalCount": "# Abnormal Vitals",
    "Flag_Tachycardia": "Flag: Tachycardia",
    "Flag_Hypo_O2": "Flag: Low O₂",
    "Flag_Fever": "Flag: Fever",
    "Flag_Tachypnea": "Flag: Tachypnea",
    "Flag_Hypertension": "Flag: Hypertension",
    "Flag_Hypotension": "Flag: Hypotension",
}

# Risk tiers on the mean predicted probability, right-closed:
# (0, .35], (.35, .55], (.55, 1].
RISK_EDGES: list[float] = [0.0, 0.35, 0.55, 1.0]
RISK_LABELS: list[str] = ["Low Risk (<35%)", "Medium Risk (35–55%)", "High Risk (>55%)"]

# Severity bands on a percentage (strictly greater than the bound).
RATE_BANDS: list[tuple[float, str]] = [(60.0, "High"), (45.0, "Medium")]
RISK_BANDS: list[tuple[float, str]] = [(55.0, "High"), (35.0, "Medium")]
BAND_DEFAULT = "Low"

# Capacity what-if scenario constants.
CAPACITY_PER_WEEK = 44
BASELINE_FLIP_RATE = 0.46
WEEKS_PER_YEAR = 52
CONVERSION_SHARE = 0.2
REVENUE_PER_PATIENT = 700
SCENARIO_TARGETS: list[int] = [10, 15, 20, 25, 30, 35, 40, 45]

# Model training defaults.
SPLIT_SEED = 42
TEST_FRACTION = 0.2
N_FOLDS = 5
LR_C = 1.0
LR_MAX_ITER = 1000
RF_TREES = 200
RF_DEPTH = 8
GBT_ROUNDS = 200
GBT_DEPTH = 4
GBT_STEP = 0.05
IMPORTANCE_TOP = 20
F1_EPS = 1e-9

# Missing-value tokens recognised when text files are read.
NULL_TOKENS: list[str] = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --------------------------------------------------------------------------
# Default column names of the encounter table.
# --------------------------------------------------------------------------
ID = "encounter_id"
OUTCOME = "Flipped"
CODE = "DRG01"
DIAGNOSIS = "DiagnosisName"
INSURANCE_RAW = "PrimaryInsuranceCategory"
INSURANCE = "InsuranceGroup"
AGE = "Age"
AGE_GROUP = "AgeGroup"
AGE_GROUP_ORD = "age_group_ord"
GENDER = "Gender"
LOS = "OU_LOS_hrs"
BP_UPPER = "BloodPressureUpper"
BP_LOWER = "BloodPressureLower"
BP_DIFF = "BloodPressureDiff"
RESP = "Respirations"
ABNORMAL_COUNT = "AbnormalVitalCount"
EXCLUSION_FLAG = "OnExpandedExclusionList"
GENDER_BINARY = "GenderBinary"
