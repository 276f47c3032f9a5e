"""Queries for distributions, split/folds, evaluation, risk and scenarios, with oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import config as C
from ..operators import cohort as CO
from ..operators import distribution as DI
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import profile as PR
from ..operators import risk as RI
from ..operators import scenario as SC
from ..operators import split as SP
from ..sources.fixtures import labelled_documents
from . import oracle as O
from .encounters import cleaned_encounters, rule_score, split_encounters
from .models import binary_features
from .registry_profile import COHORT, _COHORT_WHERE, _CODE_KEPT, _INS_KEPT

EVAL_QUERIES = {}
EVAL_SQL = {}


def register(name, sql=None):
    def deco(fn):
        EVAL_QUERIES[name] = fn
        if sql is not None:
            EVAL_SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- distributions

def _box_sql(value: str, group: str, source: str = "clean") -> tuple[str, str]:
    ctes = (
        f"st AS (SELECT {group}, COUNT({value}) AS n, quantile_cont({value}, 0.25) AS q1,"
        f" quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3,"
        f" AVG({value}) AS mean, {O.fixed_sql(f'stddev_pop({value})', 9)} AS sd,"
        f" MIN({value}) AS min, MAX({value}) AS max FROM {source}"
        f" WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY {group}),"
        " st2 AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,"
        " q3 + 1.5 * (q3 - q1) AS upper_fence FROM st),"
        f" wh AS (SELECT c.{group}, MIN(CASE WHEN c.{value} >= s.lower_fence THEN c.{value} END) AS lower_whisker,"
        f" MAX(CASE WHEN c.{value} <= s.upper_fence THEN c.{value} END) AS upper_whisker,"
        f" COUNT(*) FILTER (WHERE c.{value} < s.lower_fence OR c.{value} > s.upper_fence) AS n_outliers"
        f" FROM {source} c JOIN st2 s ON c.{group} = s.{group} WHERE c.{value} IS NOT NULL GROUP BY c.{group})")
    return ctes, f"SELECT * FROM st2 JOIN wh USING ({group})"


_c, _s = _box_sql("OU_LOS_hrs", "DiagnosisName")


@register("los_box_summary", O.with_clean(_s, _c))
def q_los_box_summary(spark, sf_dir):
    return DI.box_summary(cleaned_encounters(spark, sf_dir), C.LOS, [C.DIAGNOSIS], sd_digits=9)


_c, _s = _box_sql("OU_LOS_hrs", "Flipped")


@register("los_box_by_outcome", O.with_clean(_s, _c))
def q_los_box_by_outcome(spark, sf_dir):
    return DI.box_summary(cleaned_encounters(spark, sf_dir), C.LOS, [C.OUTCOME], sd_digits=9)


@register("los_outliers", O.with_clean(
    "SELECT c.encounter_id, c.DiagnosisName, c.OU_LOS_hrs FROM clean c JOIN st2 s USING (DiagnosisName)"
    " WHERE c.OU_LOS_hrs < s.lower_fence OR c.OU_LOS_hrs > s.upper_fence",
    _box_sql("OU_LOS_hrs", "DiagnosisName")[0]))
def q_los_outliers(spark, sf_dir):
    return DI.box_outliers(cleaned_encounters(spark, sf_dir), C.LOS, [C.DIAGNOSIS], keep=[C.ID])


def _density_sql(value: str, group: str, n_grid: int = 64, n_bins: int = 256) -> tuple[str, str]:
    sqrt2pi = repr(math.sqrt(2.0 * math.pi))
    ctes = (
        f"st AS (SELECT {group}, COUNT({value}) AS n, MIN({value}) AS lo, MAX({value}) AS hi,"
        f" stddev_pop({value}) AS sd, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3"
        f" FROM clean WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY {group}),"
        " st2 AS (SELECT *, LEAST(sd, (q3 - q1) / CAST(1.34 AS DOUBLE)) AS a FROM st),"
        f" st3 AS (SELECT {group}, n, lo, hi, CAST(0.9 AS DOUBLE) * (CASE WHEN a > 0 THEN a WHEN sd > 0 THEN sd"
        " ELSE CAST(1.0 AS DOUBLE) END) * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS h,"
        f" (hi - lo) / CAST({float(n_bins)} AS DOUBLE) AS w FROM st2),"
        f" bins AS (SELECT c.{group}, CASE WHEN s.w > 0 THEN LEAST(FLOOR((c.{value} - s.lo) / s.w), {n_bins - 1})"
        f" ELSE 0 END AS b, s.lo, s.w, COUNT(*) AS cnt FROM clean c JOIN st3 s ON c.{group} = s.{group}"
        f" WHERE c.{value} IS NOT NULL GROUP BY 1, 2, 3, 4),"
        f" centers AS (SELECT {group}, lo + (b + CAST(0.5 AS DOUBLE)) * w AS center, cnt FROM bins),"
        f" grid AS (SELECT {group}, point, lo + CAST(point AS DOUBLE) * (hi - lo) / CAST({float(n_grid - 1)} AS DOUBLE)"
        f" AS x, n, h FROM st3, range(0, {n_grid}) t(point))")
    z = "((g.x - c.center) / g.h)"
    sel = (f"SELECT g.{group}, CAST(g.point AS INTEGER) AS point, g.x,"
           f" {O.fixed_sql(f'SUM(c.cnt * exp(CAST(-0.5 AS DOUBLE) * {z} * {z})) / (g.n * g.h * CAST({sqrt2pi} AS DOUBLE))', 12)}"
           f" AS density FROM grid g JOIN centers c ON g.{group} = c.{group}"
           f" GROUP BY g.{group}, g.point, g.x, g.n, g.h")
    return ctes, sel


_c, _s = _density_sql("OU_LOS_hrs", "Flipped")


@register("los_density", O.with_clean(_s, _c))
def q_los_density(spark, sf_dir):
    return DI.density(cleaned_encounters(spark, sf_dir), C.LOS, [C.OUTCOME], digits=12)


def _hist_sql(value: str, by: str, n_bins: int, where: str = "") -> tuple[str, str]:
    cond = f"{value} IS NOT NULL AND {by} IS NOT NULL" + (f" AND ({where})" if where else "")
    raw = f"((hi - lo) / CAST({float(n_bins)} AS DOUBLE))"
    p = f"pow(CAST(10.0 AS DOUBLE), FLOOR(log10({raw})))"
    ctes = (
        f"hb AS (SELECT * FROM clean WHERE {cond}),"
        f" rng AS (SELECT MIN({value}) AS lo, MAX({value}) AS hi FROM hb),"
        f" wd AS (SELECT CASE WHEN hi - lo > 0 THEN (CASE WHEN {raw} / {p} <= 1 THEN {p}"
        f" WHEN {raw} / {p} <= 2 THEN 2 * {p} WHEN {raw} / {p} <= 5 THEN 5 * {p} ELSE 10 * {p} END)"
        " ELSE CAST(1.0 AS DOUBLE) END AS width FROM rng),"
        f" hbins AS (SELECT {by}, FLOOR({value} / width) * width AS bin_start, width, COUNT(*) AS count"
        f" FROM hb, wd GROUP BY 1, 2, 3)")
    sel = (f"SELECT {by}, bin_start, bin_start + width AS bin_end, count,"
           f" CAST(count AS DOUBLE) * 100.0 / CAST(SUM(count) OVER (PARTITION BY {by}) AS DOUBLE) AS pct FROM hbins")
    return ctes, sel


_c, _s = _hist_sql("Age", "Flipped", 20)


@register("age_histogram", O.with_clean(_s, _c))
def q_age_histogram(spark, sf_dir):
    return DI.histogram(cleaned_encounters(spark, sf_dir), C.AGE, C.OUTCOME, 20)


_c, _s = _hist_sql("Age", "Flipped", 16, _COHORT_WHERE)


@register("cohort_age_histogram", O.with_clean(_s, _c))
def q_cohort_age_histogram(spark, sf_dir):
    df = CO.cohort_filter(cleaned_encounters(spark, sf_dir), **COHORT)
    return DI.histogram(df, C.AGE, C.OUTCOME, 16)


# ---------------------------------------------------------------- split and folds

_NTEST = "CEIL(CAST(0.2 AS DOUBLE) * ncls)"
SPLIT_CTE = (
    "sp AS (SELECT *, md5('42:' || CAST(encounter_id AS VARCHAR)) AS hk FROM clean),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY Flipped ORDER BY hk, encounter_id) - 1 AS rnk,"
    " COUNT(*) OVER (PARTITION BY Flipped) AS ncls FROM sp),"
    f" split AS (SELECT * EXCLUDE (hk, rnk, ncls), CASE WHEN rnk < {_NTEST} THEN 'test' ELSE 'train' END AS split,"
    f" CASE WHEN rnk >= {_NTEST} THEN CAST((rnk - {_NTEST}) % 5 AS INTEGER) END AS fold FROM rk)")


@register("stratified_split", O.with_clean(
    "SELECT encounter_id, Flipped, split, fold FROM split", SPLIT_CTE))
def q_stratified_split(spark, sf_dir):
    return split_encounters(spark, sf_dir).select(C.ID, C.OUTCOME, "split", "fold")


@register("stratified_folds", O.with_clean(
    "SELECT fold, Flipped, COUNT(*) AS n FROM split WHERE fold IS NOT NULL GROUP BY 1, 2", SPLIT_CTE))
def q_stratified_folds(spark, sf_dir):
    return SP.fold_sizes(split_encounters(spark, sf_dir))


@register("class_balance", O.with_clean(
    "SELECT split, COUNT(*) AS n, CAST(SUM(Flipped) AS BIGINT) AS n_positive,"
    " CAST(SUM(Flipped) AS DOUBLE) / COUNT(*) AS positive_rate FROM split GROUP BY split", SPLIT_CTE))
def q_class_balance(spark, sf_dir):
    return SP.split_balance(split_encounters(spark, sf_dir))


_FEATS = C.BASE_FEATURES + [f"Ins_{v}" for v in _INS_KEPT] + [f"DRG_{v}" for v in _CODE_KEPT]
_FEAT_SQL = (", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.BASE_FEATURES)
             + ", " + ", ".join(f"CAST(COALESCE(InsuranceGroup = '{v}', FALSE) AS DOUBLE) AS Ins_{v}" for v in _INS_KEPT)
             + ", " + ", ".join(f"CAST(COALESCE(DRG01 = {v}, FALSE) AS DOUBLE) AS DRG_{v}" for v in _CODE_KEPT))
_STD_CTE = (SPLIT_CTE + f", fx AS (SELECT encounter_id, split, {_FEAT_SQL} FROM split),"
            " fs AS (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _FEATS)
            + " FROM fx WHERE split = 'train')")


@register("standardised_features", O.with_clean(
    "SELECT encounter_id, split, " + ", ".join(
        f"round_even((({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE CAST(1.0 AS DOUBLE) END)"
        f" * CAST(1000000000.0 AS DOUBLE), 0) / CAST(1000000000.0 AS DOUBLE) AS {c}" for c in _FEATS)
    + " FROM fx CROSS JOIN fs", _STD_CTE))
def q_standardised_features(spark, sf_dir):
    d, feats = FE.model_features(split_encounters(spark, sf_dir))
    z = SP.standardise(d, feats, F.col("split") == "train", digits=9, binary=binary_features(feats))
    return z.select(C.ID, "split", *feats)


# ---------------------------------------------------------------- evaluation

SCORE_CTE = (
    SPLIT_CTE + ", sc AS (SELECT *, CAST((encounter_id % 211) + 96 * OnExpandedExclusionList"
    " + 24 * AbnormalVitalCount AS DOUBLE) / CAST(512.0 AS DOUBLE) AS score FROM split WHERE split = 'test'),"
    " g AS (SELECT score, CAST(SUM(Flipped) AS BIGINT) AS pos, CAST(COUNT(Flipped) - SUM(Flipped) AS BIGINT) AS neg"
    " FROM sc GROUP BY score),"
    " cur AS (SELECT score, pos, neg,"
    " SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,"
    " SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,"
    " SUM(pos) OVER () AS P, SUM(neg) OVER () AS N,"
    " row_number() OVER (ORDER BY score DESC) = 1 AS is_first,"
    " LEAD(pos) OVER (ORDER BY score DESC) AS next_pos, LEAD(neg) OVER (ORDER BY score DESC) AS next_neg FROM g),"
    " pr AS (SELECT score AS threshold, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision,"
    " CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS recall FROM cur),"
    " best AS (SELECT threshold, precision, recall,"
    " CAST(2.0 AS DOUBLE) * precision * recall / (precision + recall + 1e-9) AS f1 FROM pr"
    " ORDER BY f1 DESC, threshold ASC LIMIT 1),"
    " cm AS (SELECT COUNT(*) FILTER (WHERE Flipped = 0 AND NOT score >= threshold) AS tn,"
    " COUNT(*) FILTER (WHERE Flipped = 0 AND score >= threshold) AS fp,"
    " COUNT(*) FILTER (WHERE Flipped = 1 AND NOT score >= threshold) AS fn,"
    " COUNT(*) FILTER (WHERE Flipped = 1 AND score >= threshold) AS tp FROM sc CROSS JOIN best)")


def scored_test(spark, sf_dir):
    d = split_encounters(spark, sf_dir).where(F.col("split") == "test")
    return rule_score(d)


def _curve(spark, sf_dir):
    return EV.score_curve(scored_test(spark, sf_dir), C.OUTCOME, "score")


@register("pr_curve", O.with_clean(
    "SELECT * FROM pr UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)", SCORE_CTE))
def q_pr_curve(spark, sf_dir):
    return EV.pr_curve(_curve(spark, sf_dir))


@register("best_f1_threshold", O.with_clean("SELECT * FROM best", SCORE_CTE))
def q_best_f1_threshold(spark, sf_dir):
    return EV.best_f1_threshold(_curve(spark, sf_dir))


@register("roc_auc", O.with_clean(
    "SELECT CAST(2 * SUM(CAST(pos AS HUGEINT) * (N - fp)) + SUM(CAST(pos AS HUGEINT) * neg) AS DOUBLE)"
    " / (CAST(2.0 AS DOUBLE) * CAST(MAX(P) AS DOUBLE) * CAST(MAX(N) AS DOUBLE)) AS roc_auc FROM cur", SCORE_CTE))
def q_roc_auc(spark, sf_dir):
    return EV.roc_auc(_curve(spark, sf_dir))


@register("average_precision", O.with_clean(
    "SELECT " + O.fixed_sql("SUM(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) / CAST(MAX(P) AS DOUBLE)", 12)
    + " AS average_precision FROM cur", SCORE_CTE))
def q_average_precision(spark, sf_dir):
    return EV.average_precision(_curve(spark, sf_dir), digits=12)


@register("roc_curve", O.with_clean(
    "SELECT CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr, CAST(NULL AS DOUBLE) AS threshold"
    " UNION ALL SELECT CAST(fp AS DOUBLE) / CAST(N AS DOUBLE), CAST(tp AS DOUBLE) / CAST(P AS DOUBLE), score FROM cur"
    " WHERE is_first OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg", SCORE_CTE))
def q_roc_curve(spark, sf_dir):
    return EV.roc_curve(_curve(spark, sf_dir))


@register("roc_curve_all_points", O.with_clean(
    "SELECT CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr, CAST(NULL AS DOUBLE) AS threshold"
    " UNION ALL SELECT CAST(fp AS DOUBLE) / CAST(N AS DOUBLE), CAST(tp AS DOUBLE) / CAST(P AS DOUBLE), score FROM cur",
    SCORE_CTE))
def q_roc_curve_all_points(spark, sf_dir):
    return EV.roc_curve(_curve(spark, sf_dir), drop_intermediate=False)


def _counts(spark, sf_dir):
    sc = scored_test(spark, sf_dir)
    best = EV.best_f1_threshold(EV.score_curve(sc, C.OUTCOME, "score"))
    return EV.confusion_counts(sc, best, C.OUTCOME, "score")


@register("confusion_matrix", O.with_clean(
    "SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cm UNION ALL SELECT 0, 1, fp FROM cm"
    " UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm", SCORE_CTE))
def q_confusion_matrix(spark, sf_dir):
    return EV.confusion_matrix(_counts(spark, sf_dir))


def _report_sql() -> str:
    d = lambda c: f"CAST({c} AS DOUBLE)"
    tn, fp, fn, tp = d("tn"), d("fp"), d("fn"), d("tp")
    z = lambda a, b: f"COALESCE(({a}) / NULLIF(({b}), 0), CAST(0.0 AS DOUBLE))"
    p1, r1 = z(tp, f"{tp} + {fp}"), z(tp, f"{tp} + {fn}")
    p0, r0 = z(tn, f"{tn} + {fn}"), z(tn, f"{tn} + {fp}")
    f11 = z(f"CAST(2.0 AS DOUBLE) * {tp}", f"CAST(2.0 AS DOUBLE) * {tp} + {fn} + {fp}")
    f10 = z(f"CAST(2.0 AS DOUBLE) * {tn}", f"CAST(2.0 AS DOUBLE) * {tn} + {fn} + {fp}")
    s0, s1 = f"({tn} + {fp})", f"({tp} + {fn})"
    n = f"({s0} + {s1})"
    acc = z(f"{tp} + {tn}", n)
    w = lambda a, b: z(f"{a} * {s0} + {b} * {s1}", n)
    two = "CAST(2.0 AS DOUBLE)"
    nul = "CAST(NULL AS DOUBLE)"
    rows = [("0", p0, r0, f10, s0), ("1", p1, r1, f11, s1), ("accuracy", nul, nul, acc, n),
            ("macro avg", f"({p0} + {p1}) / {two}", f"({r0} + {r1}) / {two}", f"({f10} + {f11}) / {two}", n),
            ("weighted avg", w(p0, p1), w(r0, r1), w(f10, f11), n)]
    return " UNION ALL ".join(
        f"SELECT '{k}' AS class, {p} AS precision, {r} AS recall, {f} AS f1_score, CAST({s} AS BIGINT) AS support FROM cm"
        for k, p, r, f, s in rows)


@register("classification_report", O.with_clean(_report_sql(), SCORE_CTE))
def q_classification_report(spark, sf_dir):
    return EV.classification_report(_counts(spark, sf_dir))


# ---------------------------------------------------------------- risk

def _tier_sql(e: str) -> str:
    return (f"CASE WHEN {e} > 0 AND {e} <= 0.35 THEN 'Low Risk (<35%)' WHEN {e} > 0.35 AND {e} <= 0.55 THEN 'Medium Risk (35–55%)'"
            f" WHEN {e} > 0.55 AND {e} <= 1 THEN 'High Risk (>55%)' ELSE NULL END")


_DRG_CASE = O._case_map("DRG01", C.DRG_NAMES, False)
# A second deterministic score whose mean per diagnosis reaches all three tiers.
_RISK_CTE = SCORE_CTE + (
    ", rs AS (SELECT * REPLACE (CAST((encounter_id % 211) + 224 * OnExpandedExclusionList + 60 * (DRG01 % 2)"
    " + 24 * AbnormalVitalCount AS DOUBLE) / CAST(512.0 AS DOUBLE) AS score) FROM sc)"
    ", risk AS (SELECT DRG01, AVG(score) AS Avg_Prob,"
    " CAST(SUM(Flipped) AS DOUBLE) / CAST(COUNT(Flipped) AS DOUBLE) AS Actual_Rate, COUNT(DRG01) AS Count,"
    f" {_DRG_CASE} AS DiagnosisName, {O.pct_sql('AVG(score)')} AS Avg_Prob_Pct,"
    f" {O.pct_sql('CAST(SUM(Flipped) AS DOUBLE) / CAST(COUNT(Flipped) AS DOUBLE)')} AS Actual_Pct,"
    f" {_tier_sql('AVG(score)')} AS Risk_Tier FROM rs WHERE DRG01 IS NOT NULL GROUP BY DRG01)")


def risk_scored_rule(spark, sf_dir):
    raw = ((F.col(C.ID) % 211) + 224 * F.col(C.EXCLUSION_FLAG) + 60 * (F.col(C.CODE) % 2) + 24 * F.col(C.ABNORMAL_COUNT))
    scored = scored_test(spark, sf_dir).withColumn("score", raw.cast("double") / F.lit(512.0))
    return RI.risk_by_key(scored, C.CODE, "score", C.OUTCOME)


@register("risk_by_diagnosis", O.with_clean("SELECT * FROM risk", _RISK_CTE))
def q_risk_by_diagnosis(spark, sf_dir):
    return risk_scored_rule(spark, sf_dir).orderBy("Avg_Prob_Pct", C.CODE)


@register("high_risk_tier", O.with_clean(
    "SELECT * FROM risk WHERE Risk_Tier = 'High Risk (>55%)'", _RISK_CTE))
def q_high_risk_tier(spark, sf_dir):
    return CO.tier_filter(risk_scored_rule(spark, sf_dir), "Risk_Tier", C.RISK_LABELS[2])


_BAND = "CASE WHEN Avg_Prob_Pct > 55 THEN 'High' WHEN Avg_Prob_Pct > 35 THEN 'Medium' ELSE 'Low' END"


@register("risk_display", O.with_clean(
    "SELECT * REPLACE (COALESCE(DiagnosisName, CAST(DRG01 AS VARCHAR)) AS DiagnosisName),"
    f" {_BAND} AS Risk_Band FROM risk", _RISK_CTE))
def q_risk_display(spark, sf_dir):
    return RI.display_risk(risk_scored_rule(spark, sf_dir))


@register("risk_fallback_observed", O.with_clean(
    "SELECT DRG01, DiagnosisName, CAST(SUM(Flipped) AS DOUBLE) / CAST(COUNT(Flipped) AS DOUBLE) AS Avg_Prob,"
    " COUNT(Flipped) AS Count, CAST(SUM(Flipped) AS DOUBLE) / CAST(COUNT(Flipped) AS DOUBLE) AS Actual_Rate,"
    f" {O.pct_sql('CAST(SUM(Flipped) AS DOUBLE) / CAST(COUNT(Flipped) AS DOUBLE)')} AS Avg_Prob_Pct"
    " FROM clean WHERE DRG01 IS NOT NULL AND DiagnosisName IS NOT NULL GROUP BY DRG01, DiagnosisName"))
def q_risk_fallback_observed(spark, sf_dir):
    return RI.risk_table(cleaned_encounters(spark, sf_dir), None)


# ---------------------------------------------------------------- scenarios

def _scen_sql(base_cte: str, keys: str) -> tuple[str, str]:
    t = ", ".join(str(x) for x in C.SCENARIO_TARGETS)
    b = C.CAPACITY_PER_WEEK
    proj = (f"CAST({float(b)} AS DOUBLE) * (CAST(1.0 AS DOUBLE) - target_pct / 100)"
            " / NULLIF(CAST(1.0 AS DOUBLE) - baseline_rate, 0)")
    extra = f"GREATEST(0, CAST(round_even({proj}, 0) AS BIGINT) - {b})"
    ctes = (base_cte + f", tg AS (SELECT unnest([{t}]) AS target_pct),"
            f" scen AS (SELECT {keys}baseline_rate, target_pct, {extra} AS extra_per_week FROM bl, tg),"
            f" scen2 AS (SELECT *, extra_per_week * {C.WEEKS_PER_YEAR} AS extra_per_year FROM scen)")
    sel = (f"SELECT {keys}baseline_rate, target_pct, extra_per_week, extra_per_year,"
           f" CAST(round_even(extra_per_year * CAST({C.CONVERSION_SHARE!r} AS DOUBLE), 0) AS BIGINT)"
           f" * {C.REVENUE_PER_PATIENT} AS revenue, extra_per_week + {b} AS projected_per_week FROM scen2")
    return ctes, sel


_c, _s = _scen_sql(
    "bl AS (SELECT DiagnosisName, CAST(SUM(Flipped) AS DOUBLE) / CAST(COUNT(Flipped) AS DOUBLE) AS baseline_rate"
    " FROM clean WHERE DiagnosisName IS NOT NULL GROUP BY DiagnosisName)", "DiagnosisName, ")


def _segment_baselines(spark, sf_dir):
    return PR.outcome_rate(cleaned_encounters(spark, sf_dir), C.DIAGNOSIS).select(
        C.DIAGNOSIS, F.col("Flip_Rate").alias("baseline_rate"))


@register("capacity_scenarios", O.with_clean(_s, _c))
def q_capacity_scenarios(spark, sf_dir):
    return SC.capacity_scenarios(_segment_baselines(spark, sf_dir))


_c, _s = _scen_sql(
    "bl AS (SELECT CAST(SUM(Flipped) AS DOUBLE) / CAST(COUNT(Flipped) AS DOUBLE) AS baseline_rate FROM clean)", "")


@register("capacity_waterfall", O.with_clean(
    "SELECT target_pct, 0 AS step, 'Current Baseline' AS label, 'absolute' AS measure,"
    f" CAST({C.CAPACITY_PER_WEEK} AS BIGINT) AS value FROM w"
    " UNION ALL SELECT target_pct, 1, 'Reduce flip to ' || CAST(target_pct AS VARCHAR) || '%', 'relative',"
    " extra_per_week FROM w"
    " UNION ALL SELECT target_pct, 2, 'Projected Capacity', 'total', projected_per_week FROM w",
    _c + f", w AS ({_s})"))
def q_capacity_waterfall(spark, sf_dir):
    base = PR.overall_rate(cleaned_encounters(spark, sf_dir)).select(
        F.col("Overall_Rate").alias("baseline_rate"))
    return SC.capacity_waterfall(SC.capacity_scenarios(base))


# ---------------------------------------------------------------- second domain

_DOC_CTE = "ld AS (SELECT l.*, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id))"


def _doc_rate_sql(key: str, outcome: str) -> str:
    return (f"SELECT {key}, CAST(SUM({outcome}) AS BIGINT) AS n_positive, COUNT({outcome}) AS n,"
            f" CAST(SUM({outcome}) AS DOUBLE) / CAST(COUNT({outcome}) AS DOUBLE) AS rate,"
            f" {O.pct_sql(f'CAST(SUM({outcome}) AS DOUBLE) / CAST(COUNT({outcome}) AS DOUBLE)')} AS pct"
            f" FROM ld WHERE {key} IS NOT NULL GROUP BY {key}")


_DOC_NAMES = dict(count_name="n_positive", total_name="n", rate_name="rate", pct_name="pct")


@register("outcome_rate_documents", "WITH " + _DOC_CTE + " " + _doc_rate_sql("lang", "quality"))
def q_outcome_rate_documents(spark, sf_dir):
    return PR.outcome_rate(labelled_documents(spark, sf_dir), "lang", "quality", **_DOC_NAMES)


@register("toxic_rate_by_source", "WITH " + _DOC_CTE + " " + _doc_rate_sql("source", "toxic"))
def q_toxic_rate_by_source(spark, sf_dir):
    return PR.outcome_rate(labelled_documents(spark, sf_dir), "source", "toxic", **_DOC_NAMES)


_c, _s = _box_sql("n_chars", "quality", "ld")


@register("document_length_box", "WITH " + _DOC_CTE + ", " + _c + " " + _s)
def q_document_length_box(spark, sf_dir):
    return DI.box_summary(labelled_documents(spark, sf_dir), "n_chars", ["quality"], sd_digits=9)


@register("feature_matrix_shape", O.with_clean(
    f"SELECT COUNT(*) AS n_rows, CAST({len(_FEATS)} AS BIGINT) AS n_features,"
    " CAST(SUM(Flipped) AS DOUBLE) / CAST(COUNT(Flipped) AS DOUBLE) AS positive_rate FROM clean"))
def q_feature_matrix_shape(spark, sf_dir):
    """rows x features of the model matrix and the class balance."""
    d, feats = FE.model_features(cleaned_encounters(spark, sf_dir))
    return d.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.lit(len(feats)).cast("bigint").alias("n_features"),
                 (F.sum(C.OUTCOME).cast("double") / F.count(C.OUTCOME).cast("double")).alias("positive_rate"))
