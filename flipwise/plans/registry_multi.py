"""Side-by-side evaluation of several scores, importances, file round trips and cohort compositions, with SQL oracles.

The three scores are deterministic functions of a row, so SQL can check the
very functions that the model queries use: ``rule`` has a few hundred values,
``spread`` many thousands, ``rare`` lies on the scale of rare events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import cohort as CO
from ..operators import cube as CU
from ..operators import distribution as DI
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import profile as PR
from ..operators import scenario as SC
from ..session import ensure_checkpoint_dir
from ..sources.tables import publish_table, read_csv, read_published, table, write_table
from . import models as M
from . import oracle as O
from .encounters import cleaned_encounters, split_encounters, stored_once
from .registry_eval import _FEATS, SPLIT_CTE, _box_sql, _density_sql, _hist_sql, _scen_sql
from .registry_profile import _COHORT_WHERE, COHORT, _by_outcome_cte, _flag_sql, _rate_sql

MULTI_QUERIES = {}
MULTI_SQL = {}
SCORES = ["rule", "spread", "rare"]


def register(name, sql):
    def deco(fn):
        MULTI_QUERIES[name] = fn
        MULTI_SQL[name] = sql
        return fn
    return deco


def several_scores(df: DataFrame) -> DataFrame:
    """One row per (row, model): KEEP columns, split, fold, model, score."""
    i, flag, count = F.col(C.ID), F.col(C.EXCLUSION_FLAG), F.col(C.ABNORMAL_COUNT)
    raw = {"rule": ((i % 211) + 96 * flag + 24 * count, 512.0), "spread": ((i * 7919) % 100003 + 20000 * flag, 131072.0),
           "rare": ((i % 997) + 211 * flag, 134217728.0)}
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), (raw[m][0].cast("double") / F.lit(raw[m][1])).alias("score")) for m in SCORES])
    return df.select(*M.KEEP, "split", "fold", F.inline(pairs))


_LONG = (SPLIT_CTE + ", sx AS (SELECT *, unnest([{'model': 'rule', 'score': CAST((encounter_id % 211) + 96 * OnExpandedExclusionList"
         " + 24 * AbnormalVitalCount AS DOUBLE) / CAST(512 AS DOUBLE)},"
         " {'model': 'spread', 'score': CAST((encounter_id * 7919) % 100003 + 20000 * OnExpandedExclusionList AS DOUBLE) / CAST(131072 AS DOUBLE)},"
         " {'model': 'rare', 'score': CAST((encounter_id % 997) + 211 * OnExpandedExclusionList AS DOUBLE) / CAST(134217728 AS DOUBLE)}]) AS ms FROM split),"
         " sl AS (SELECT Flipped, split, fold, ms.model AS model, ms.score AS score FROM sx)")


def _curve_sql(prefix: str, source: str, keys: str) -> str:
    w = f"PARTITION BY {keys} ORDER BY score DESC"
    return (f", {prefix}g AS (SELECT {keys}, score, CAST(SUM(Flipped) AS BIGINT) AS pos, CAST(COUNT(*) - SUM(Flipped) AS BIGINT) AS neg"
            f" FROM ({source}) GROUP BY {keys}, score),"
            f" {prefix}c AS (SELECT *, SUM(pos) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,"
            f" SUM(neg) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,"
            f" SUM(pos) OVER (PARTITION BY {keys}) AS P, SUM(neg) OVER (PARTITION BY {keys}) AS N FROM {prefix}g),"
            f" {prefix}auc AS (SELECT {keys}, CAST(2 * SUM(CAST(pos AS HUGEINT) * (N - fp)) + SUM(CAST(pos AS HUGEINT) * neg) AS DOUBLE)"
            f" / (CAST(2 AS DOUBLE) * CAST(MAX(P) AS DOUBLE) * CAST(MAX(N) AS DOUBLE)) AS roc_auc FROM {prefix}c GROUP BY {keys})")


_D = "CAST({} AS DOUBLE)".format
_METRICS = (
    _LONG + _curve_sql("t", "SELECT * FROM sl WHERE split = 'test'", "model")
    + _curve_sql("f", "SELECT * FROM sl WHERE fold IS NOT NULL", "model, fold")
    + ", pr AS (SELECT model, score AS threshold, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS pre, CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS rec, tp, fp, P, N FROM tc),"
      " bt AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY CAST(2 AS DOUBLE) * pre * rec / (pre + rec + 1e-9) DESC, threshold) AS k FROM pr),"
      " bm AS (SELECT model, threshold, pre AS precision_1, rec AS recall_1,"
      f" {_D(2)} * {_D('tp')} / ({_D(2)} * {_D('tp')} + {_D('P - tp')} + {_D('fp')}) AS f1_1,"
      f" {_D('tp + N - fp')} / {_D('P + N')} AS accuracy FROM bt WHERE k = 1),"
      f" ap AS (SELECT model, {O.fixed_sql('SUM(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) / CAST(MAX(P) AS DOUBLE)', 12)} AS average_precision"
      " FROM tc GROUP BY model),"
      f" cva AS (SELECT model, {O.fixed_sql('AVG(roc_auc)', 12)} AS cv_auc_mean, {O.fixed_sql('stddev_pop(roc_auc)', 12)} AS cv_auc_sd FROM fauc GROUP BY model),"
      " mm AS (SELECT model, roc_auc, average_precision, cv_auc_mean, cv_auc_sd, threshold, precision_1, recall_1, f1_1, accuracy,"
      " CASE model WHEN 'rule' THEN 0 WHEN 'spread' THEN 1 ELSE 2 END AS position"
      " FROM tauc JOIN ap USING (model) JOIN cva USING (model) JOIN bm USING (model))")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    long = several_scores(split_encounters(spark, sf_dir))
    return long.where(F.col("split") == "test"), long.where(F.col("fold").isNotNull())


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve state of the three scores, one scan of the split table, stored once per application."""
    return stored_once(spark, sf_dir, "curve-state", lambda: M.curve_state(*_scored(spark, sf_dir)))


def _metrics(spark, sf_dir):
    return M.state_metrics(_state(spark, sf_dir), SCORES, digits=12)


@register("multi_metrics", O.with_clean("SELECT * FROM mm", _METRICS))
def q_multi_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@register("multi_comparison", O.with_clean(
    "SELECT model AS \"Model\", printf('%.3f', roc_auc) AS \"ROC-AUC\","
    " printf('%.3f', cv_auc_mean) || ' ± ' || printf('%.3f', cv_auc_sd) AS \"CV-AUC (5-fold)\","
    " printf('%.3f', precision_1) AS \"Precision (Flip)\", printf('%.3f', recall_1) AS \"Recall (Flip)\","
    " printf('%.3f', f1_1) AS \"F1 (Flip)\", printf('%.3f', accuracy) AS \"Accuracy\", printf('%.2f', threshold) AS \"Threshold\" FROM mm", _METRICS))
def q_multi_comparison(spark, sf_dir):
    return M.comparison_table(_metrics(spark, sf_dir))


@register("multi_auc_bar", O.with_clean("SELECT model AS \"Model\", CAST(printf('%.3f', roc_auc) AS DOUBLE) AS auc FROM mm", _METRICS))
def q_multi_auc_bar(spark, sf_dir):
    return M.auc_from_text(M.comparison_table(_metrics(spark, sf_dir)))


@register("multi_best", O.with_clean("SELECT model, roc_auc FROM mm ORDER BY roc_auc DESC, position LIMIT 1", _METRICS))
def q_multi_best(spark, sf_dir):
    return M.best_model(_metrics(spark, sf_dir))


@register("multi_fold_auc", O.with_clean("SELECT model, fold, roc_auc FROM fauc", _METRICS))
def q_multi_fold_auc(spark, sf_dir):
    by = ["model", "fold"]
    return EV.roc_auc(EV.curve_of(_state(spark, sf_dir).where(F.col("fold") != M.TEST), "score", by), by)


# ---------------------------------------------------------------- importances

_LABEL_CASE = "CASE feature " + " ".join(
    [f"WHEN '{f}' THEN {O._q(lab)}" for f, lab in C.FEATURE_LABELS.items()]
    + [f"WHEN 'DRG_{c}' THEN {O._q('DRG: ' + n)}" for c, n in C.DRG_NAMES.items()]) + \
    " ELSE CASE WHEN starts_with(feature, 'DRG_') THEN 'DRG: ' || feature WHEN starts_with(feature, 'Ins_') THEN" \
    " 'Insurance: ' || split_part(feature, '_', 2) ELSE feature END END"
_FEATURE_SQL = {c: (f"CAST(COALESCE(InsuranceGroup = '{c[4:]}', FALSE) AS DOUBLE)" if c.startswith("Ins_") else
                    f"CAST(COALESCE(DRG01 = {c[4:]}, FALSE) AS DOUBLE)" if c.startswith("DRG_") else f"CAST({c} AS DOUBLE)") for c in _FEATS}


@register("importance_top20", O.with_clean(
    "SELECT 'class mean gap' AS model, feature, importance, CAST(rank AS INTEGER) AS rank, importance * 100.0 AS importance_pct,"
    f" {_LABEL_CASE} AS label FROM rk WHERE rank <= 20",
    "fv AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(AVG(CASE WHEN Flipped = 1 THEN {e} END) - AVG(CASE WHEN Flipped = 0 THEN {e} END)) AS importance FROM clean"
        for c, e in _FEATURE_SQL.items())
    + "), rk AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM fv)"))
def q_importance_top20(spark, sf_dir):
    """B20 / F19 shape on a deterministic importance: the gap between the class means of each feature."""
    d, feats = FE.model_features(cleaned_encounters(spark, sf_dir))
    y = F.col(C.OUTCOME)
    gaps = d.agg(*[F.abs(F.avg(F.when(y == 1, F.col(f))) - F.avg(F.when(y == 0, F.col(f)))).alias(f"g{i}") for i, f in enumerate(feats)])
    rows = F.array(*[F.struct(F.lit("class mean gap").alias("model"), F.lit(f).alias("feature"), F.col(f"g{i}").alias("importance"))
                     for i, f in enumerate(feats)])
    return M.top_importances(gaps.select(F.inline(rows)))


# ---------------------------------------------------------------- files (A1, A2, A5)

@register("csv_round_trip", "SELECT doc_id, md5(text) AS text_md5, length(text) AS n_text, lang, source, n_chars FROM documents")
def q_csv_round_trip(spark, sf_dir):
    """A2 then A1: texts with quotes, commas and line breaks through CSV files in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex[:12]}"
    write_table(table(spark, sf_dir, "documents"), path, "csv")
    back = read_csv(spark, path, "doc_id long, text string, lang string, source string, n_chars long", null_tokens=[])
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_text"), "lang", "source", "n_chars")


@register("rederived_keys", O.with_clean("SELECT encounter_id, DRG01, Age, DiagnosisName, AgeGroup FROM clean"))
def q_rederived_keys(spark, sf_dir):
    """A5 after a partitioned Parquet round trip."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keys-{uuid.uuid4().hex[:12]}"
    write_table(cleaned_encounters(spark, sf_dir).select(C.ID, C.CODE, C.AGE, C.DIAGNOSIS, C.AGE_GROUP, C.OUTCOME), path,
                partition_by=[C.OUTCOME])
    return FE.rederive_keys(spark.read.parquet(path)).select(C.ID, C.CODE, C.AGE, C.DIAGNOSIS, C.AGE_GROUP)


# ---------------------------------------------------------------- cohort compositions, constant baseline

_COH = f"coh AS (SELECT * FROM clean WHERE {_COHORT_WHERE}), "
_c, _s = _box_sql("OU_LOS_hrs", "Flipped", "coh")


@register("cohort_los_box", O.with_clean(_s, _COH + _c))
def q_cohort_los_box(spark, sf_dir):
    return DI.box_summary(CO.cohort_filter(cleaned_encounters(spark, sf_dir), **COHORT), C.LOS, [C.OUTCOME], sd_digits=9)


_c, _s = _density_sql("OU_LOS_hrs", "Flipped")


@register("cohort_los_density", O.with_clean(_s, _COH + _c.replace("FROM clean", "FROM coh")))
def q_cohort_los_density(spark, sf_dir):
    return DI.density(CO.cohort_filter(cleaned_encounters(spark, sf_dir), **COHORT), C.LOS, [C.OUTCOME], digits=12)


_c, _s = _scen_sql("bl AS (SELECT DISTINCT DiagnosisName, CAST(0.46 AS DOUBLE) AS baseline_rate FROM clean WHERE DiagnosisName IS NOT NULL)",
                   "DiagnosisName, ")


@register("capacity_constant_baseline", O.with_clean(_s, _c))
def q_capacity_constant_baseline(spark, sf_dir):
    segments = PR.outcome_rate(cleaned_encounters(spark, sf_dir), C.DIAGNOSIS).select(C.DIAGNOSIS)
    return SC.capacity_scenarios(segments, baseline=C.BASELINE_FLIP_RATE)


# ---------------------------------------------------------------- several profiles from one scan, the cohort cube

PROFILES = {"diagnosis": [C.DIAGNOSIS], "insurance": [C.INSURANCE], "gender": [C.GENDER], "abnormal vitals": [C.ABNORMAL_COUNT],
            "diagnosis and age": [C.DIAGNOSIS, C.AGE_GROUP]}
_PROFILE_KEYS = [C.DIAGNOSIS, C.INSURANCE, C.GENDER, C.ABNORMAL_COUNT, C.AGE_GROUP]


def _profiles_sql() -> str:
    parts = []
    for name, keys in PROFILES.items():
        columns = ", ".join(k if k in keys else f"NULL AS {k}" for k in _PROFILE_KEYS)
        parts.append(f"SELECT '{name}' AS profile, {columns}, Flipped_Count, Total, Flip_Rate, Flip_Pct FROM ({_rate_sql(keys)})")
    return " UNION ALL ".join(parts)


@register("outcome_profiles", O.with_clean(_profiles_sql()))
def q_outcome_profiles(spark, sf_dir):
    """D1 over five key sets in one scan."""
    return PR.outcome_profiles(cleaned_encounters(spark, sf_dir), PROFILES)


def cohort_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of the cleaned encounters, stored once per application."""
    return stored_once(spark, sf_dir, "cohort-cube", lambda: CU.cohort_cube(cleaned_encounters(spark, sf_dir)))


def _cohort_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.cohort_filter(cohort_cube(spark, sf_dir), **COHORT)


@register("cube_cohort_rates", O.with_clean(_rate_sql([C.DIAGNOSIS], where=_COHORT_WHERE)))
def q_cube_cohort_rates(spark, sf_dir):
    return CU.rates(_cohort_cells(spark, sf_dir), C.DIAGNOSIS)


@register("cube_cohort_kpis", O.with_clean(
    "SELECT COUNT(*) AS n_total, CAST(SUM(Flipped) AS BIGINT) AS n_flipped,"
    " CAST(SUM(Flipped) AS DOUBLE) / COUNT(Flipped) AS flip_rate,"
    f" {O.pct_sql('CAST(SUM(Flipped) AS DOUBLE) / COUNT(Flipped)')} AS flip_pct,"
    " COUNT(*) FILTER (WHERE Flipped = 0) AS n_stayed,"
    f" {O.pct_sql('CAST(COUNT(*) FILTER (WHERE Flipped = 0) AS DOUBLE) / COUNT(*)')} AS stayed_pct,"
    " AVG(OU_LOS_hrs) AS los_mean_all, AVG(CASE WHEN Flipped = 1 THEN OU_LOS_hrs END) AS los_mean_flipped,"
    " AVG(CASE WHEN Flipped = 0 THEN OU_LOS_hrs END) AS los_mean_stayed, AVG(Age) AS age_mean FROM coh", _COH.rstrip(", ")))
def q_cube_cohort_kpis(spark, sf_dir):
    return CU.kpis(_cohort_cells(spark, sf_dir))


@register("cube_cohort_flags", O.with_clean(_flag_sql(), _COH + _by_outcome_cte(C.FLAG_COLUMNS).replace("FROM clean", "FROM coh")))
def q_cube_cohort_flags(spark, sf_dir):
    return CU.flag_prevalence(_cohort_cells(spark, sf_dir))


_c, _s = _hist_sql("Age", "Flipped", 16, _COHORT_WHERE)


@register("cube_cohort_age_histogram", O.with_clean(_s, _c))
def q_cube_cohort_age_histogram(spark, sf_dir):
    return CU.histogram_by_outcome(_cohort_cells(spark, sf_dir), C.AGE, C.OUTCOME, 16)


# ---------------------------------------------------------------- inferred types (A1), published tables (A2)

_MIXED = {  # column: (Spark, DuckDB) text of a cell, from the columns of events-like keys of ``orders``
    "key": ("CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS VARCHAR)"),
    "sparse": ("CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE CAST(o_custkey AS STRING) END",
               "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END"),
    "half": ("CONCAT(CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END)",
             "CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END"),
    "yes": ("CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'FALSE' END", "CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'FALSE' END"),
    "status": ("CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END", "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END"),
    "late": ("CASE WHEN o_orderkey = 1 THEN 'x' ELSE CAST(o_orderkey AS STRING) END",
             "CASE WHEN o_orderkey = 1 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END"),
    "nothing": ("'null'", "NULL"),
}
_SUMS = {"key": "bigint", "sparse": "double", "half": "double", "yes": "boolean", "status": "string", "late": "string", "nothing": "double"}


@register("inferred_types", "WITH m AS (SELECT " + ", ".join(f"{d} AS {c}" for c, (_, d) in _MIXED.items()) + " FROM orders) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, COUNT(*) - COUNT({c}) AS n_missing, "
    + (f"CAST(SUM(CAST({c} AS DOUBLE)) AS DOUBLE)" if t in ("bigint", "double") else
       f"CAST(COUNT(*) FILTER (WHERE {c} = 'True') AS DOUBLE)" if t == "boolean" else f"CAST(SUM(LENGTH({c})) AS DOUBLE)")
    + " AS total FROM m" for c, t in _SUMS.items()))
def q_inferred_types(spark, sf_dir):
    """A1 without a schema: a file of mixed columns from ``orders``, its inferred types, and what the typed columns add up to."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/mixed-{uuid.uuid4().hex[:12]}"
    write_table(table(spark, sf_dir, "orders").selectExpr(*[f"{s} AS {c}" for c, (s, _) in _MIXED.items()]), path, "csv")
    df = read_csv(spark, path, multi_line=False)
    kinds = dict(df.dtypes)
    total = {"boolean": lambda c: F.count_if(c), "string": lambda c: F.sum(F.length(c)), "bigint": F.sum, "double": F.sum}
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in kinds],
                 *[total[t](F.col(c)).cast("double").alias(f"t_{c}") for c, t in kinds.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n_{c}").alias("n_missing"),
                                                  F.col(f"t_{c}").alias("total")) for c, t in kinds.items()])))


@register("published_profile", O.with_clean(_rate_sql([C.DIAGNOSIS])))
def q_published_profile(spark, sf_dir):
    """A2: the scored table is published twice; a reader gets the second version whole."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/published-{uuid.uuid4().hex[:12]}"
    encounters = cleaned_encounters(spark, sf_dir).select(C.ID, C.DIAGNOSIS, C.OUTCOME)
    publish_table(encounters.where(F.col(C.OUTCOME) == 1), path)
    publish_table(encounters, path)
    return PR.outcome_rate(read_published(spark, path), C.DIAGNOSIS)
