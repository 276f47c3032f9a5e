"""Queries whose sums keep every bit, curves and densities with error columns, and scores from stored model tables.

The SQL repeats the exact sums as 128-bit integers of a fixed binary scale,
which holds every bit of these terms at the sizes of the test tables, and
rounds once.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import fixed
from ..operators import distribution as DI
from ..operators import evaluate as EV
from ..operators import model_table as MT
from ..operators import train as TR
from ..session import ensure_checkpoint_dir
from ..sources.tables import publish_table, read_published
from . import models as M
from . import oracle as O
from .encounters import cleaned_encounters
from .registry_eval import _density_sql
from .registry_multi import _LONG, _curve_sql, _scored

EXACT_QUERIES = {}
EXACT_SQL = {}
ROC_POINTS, PR_POINTS = 512, 1024


def register(name, sql=None):
    def deco(fn):
        EXACT_QUERIES[name] = fn
        if sql is not None:
            EXACT_SQL[name] = sql
        return fn
    return deco


def _scaled(term: str, bits: int) -> str:
    """Sum of non-negative doubles as an integer of 2^-bits."""
    return f"SUM(CAST(({term}) * CAST({2.0 ** bits!r} AS DOUBLE) AS HUGEINT))"


def _rounded(total: str, bits: int) -> str:
    """That integer as a double, rounded once: 55 leading bits or more and a sticky bit."""
    cut = f"GREATEST(0, CAST(FLOOR(log2(CAST(GREATEST({total}, 1) AS DOUBLE))) AS INTEGER) - 55)"
    unit = f"CAST(pow(2, {cut}) AS HUGEINT)"
    return (f"(CAST(CAST(({total} // {unit}) * 2 + CASE WHEN {total} % {unit} <> 0 THEN 1 ELSE 0 END AS BIGINT) AS DOUBLE)"
            f" * pow(CAST(2 AS DOUBLE), {cut} - {bits + 1}))")


_MOMENTS = (
    "mo AS (SELECT DiagnosisName, COUNT(*) AS n, SUM(OU_LOS_hrs) AS sum, SUM(OU_LOS_hrs) / COUNT(*) AS mean FROM clean"
    " WHERE DiagnosisName IS NOT NULL AND OU_LOS_hrs IS NOT NULL GROUP BY DiagnosisName),"
    f" sq AS (SELECT DiagnosisName, {_scaled('(OU_LOS_hrs - mean) * (OU_LOS_hrs - mean)', 90)} AS t FROM clean JOIN mo USING (DiagnosisName)"
    " WHERE OU_LOS_hrs IS NOT NULL GROUP BY DiagnosisName)")


@register("exact_moments", O.with_clean(
    f"SELECT DiagnosisName, n, sum, mean, sqrt({_rounded('t', 90)} / CAST(n AS DOUBLE)) AS sd FROM mo JOIN sq USING (DiagnosisName)", _MOMENTS))
def q_exact_moments(spark, sf_dir):
    """Mean and population sd of the stay by diagnosis, unrounded."""
    return DI.exact_moments(cleaned_encounters(spark, sf_dir), C.LOS, [C.DIAGNOSIS])


_TEST = _LONG + _curve_sql("t", "SELECT * FROM sl WHERE split = 'test'", "model")


def _test_curve(spark, sf_dir):
    return EV.score_curve(_scored(spark, sf_dir)[0], by=["model"])


@register("average_precision_exact", O.with_clean(
    f"SELECT model, {_rounded('t', 80)} / p AS average_precision FROM ap",
    _TEST + f", ap AS (SELECT model, {_scaled('CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))', 80)} AS t,"
            " CAST(MAX(P) AS DOUBLE) AS p FROM tc GROUP BY model)"))
def q_average_precision_exact(spark, sf_dir):
    """F12 of three scores, unrounded."""
    return EV.average_precision_exact(_test_curve(spark, sf_dir), ["model"])


def _bounded_sql(points: str, x: str, y: str, bound: str, end: str) -> tuple[str, str]:
    """First and last point of each (model, cell) of the CTE body ``points``, with measured and stated error."""
    w = "PARTITION BY model, cell ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    ends = ", ".join(f"{f}_value({c}) OVER w AS {f[0]}{c}" for f in ("first", "last") for c in ("x", "y", "tp", "fp", "n"))
    return (f", pt AS ({points}), en AS (SELECT *, {ends} FROM pt WINDOW w AS ({w})),"
            " er AS (SELECT *, MAX(ABS(y - CASE WHEN lx - fx <> 0 THEN fy + (ly - fy) * ((x - fx) / NULLIF(lx - fx, 0)) ELSE y END))"
            f" OVER (PARTITION BY model, cell) AS error, {bound} AS error_bound FROM en)",
            f"SELECT model, x AS {x}, y AS {y}, score AS threshold, error, error_bound FROM er WHERE n = fn OR n = ln"
            f" UNION ALL SELECT DISTINCT model, CAST(0 AS DOUBLE), CAST({end} AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM pt")


_c, _s = _bounded_sql(
    "SELECT *, LEAST(CAST(FLOOR((x + y) * CAST(127.5 AS DOUBLE)) AS BIGINT), 254) AS cell FROM (SELECT model, score, tp, fp, tp + fp AS n,"
    " CAST(fp AS DOUBLE) / CAST(N AS DOUBLE) AS x, CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS y FROM (SELECT model, score, tp, fp, P, N FROM tc) q)",
    "fpr", "tpr", "ly - fy", "0")


@register("roc_curve_bounded", O.with_clean(_s, _TEST + _c))
def q_roc_curve_bounded(spark, sf_dir):
    """F17 of three scores in at most 512 points each, with the error of leaving the others out."""
    return EV.roc_curve_bounded(_test_curve(spark, sf_dir), ROC_POINTS, by=["model"])


_LEAD = "CASE " + " ".join(f"WHEN length(bin(CAST(P + N AS BIGINT))) * {2 ** (b + 1)} + 1 <= 1024 THEN {b}" for b in range(9, -1, -1)) + " END"
_HIGH, _LOW = "CAST(ltp AS DOUBLE) / CAST(ltp + ffp AS DOUBLE)", "COALESCE(CAST(ftp AS DOUBLE) / NULLIF(CAST(ftp + lfp AS DOUBLE), 0), 0)"
_c, _s = _bounded_sql(
    "SELECT *, GREATEST(length(bin(n)) - 1 - lead, 0) * CAST(4294967296 AS BIGINT) + (n >> CAST(GREATEST(length(bin(n)) - 1 - lead, 0) AS BIGINT)) AS cell"
    " FROM (SELECT model, score, tp, fp, CAST(tp + fp AS BIGINT) AS n, CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS x,"
    f" CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS y, {_LEAD} AS lead FROM (SELECT model, score, tp, fp, P, N FROM tc) q)",
    "recall", "precision", f"CASE WHEN fn = ln THEN 0 ELSE GREATEST({_HIGH} - LEAST(fy, ly), GREATEST(fy, ly) - {_LOW}) END", "1")


@register("pr_curve_bounded", O.with_clean(_s, _TEST + _c))
def q_pr_curve_bounded(spark, sf_dir):
    """F8 of three scores in at most 1,024 points each, with the error of leaving the others out."""
    return EV.pr_curve_bounded(_test_curve(spark, sf_dir), PR_POINTS, by=["model"])


def _linear_density_sql(group: str) -> tuple[str, str]:
    ctes = _density_sql("OU_LOS_hrs", group)[0].split(", bins AS ", 1)[0]
    at = "CASE WHEN s.w > 0 THEN (c.OU_LOS_hrs - s.lo) / s.w ELSE CAST(0 AS DOUBLE) END"
    ctes += (f", tt AS (SELECT c.{group}, s.lo, s.w, {at} AS t, LEAST(FLOOR({at}), 255) AS i FROM clean c JOIN st3 s ON c.{group} = s.{group}"
             " WHERE c.OU_LOS_hrs IS NOT NULL),"
             f" nd AS (SELECT {group}, lo + i * w AS node, SUM(CAST(1 AS DOUBLE) - (t - i)) AS c FROM tt GROUP BY {group}, lo, w, i"
             f" UNION ALL SELECT {group}, lo + (i + 1) * w, SUM(t - i) FROM tt GROUP BY {group}, lo, w, i),"
             f" gr AS (SELECT {group}, point, lo + CAST(point AS DOUBLE) * (hi - lo) / CAST(63.0 AS DOUBLE) AS x, n, h, w FROM st3, range(0, 64) t(point))")
    z = "((g.x - c.node) / g.h)"
    dens = f"SUM(c.c * exp(CAST(-0.5 AS DOUBLE) * {z} * {z})) / (g.n * g.h * sqrt(2 * pi()))"
    return ctes, (f"SELECT g.{group}, CAST(g.point AS INTEGER) AS point, g.x, {O.fixed_sql(dens, 11)} AS density,"
                  f" {O.fixed_sql('g.w * g.w / (8 * sqrt(2 * pi()) * g.h * g.h * g.h)', 11)} AS error_bound"
                  f" FROM gr g JOIN nd c ON g.{group} = c.{group} GROUP BY g.{group}, g.point, g.x, g.n, g.h, g.w")


_c, _s = _linear_density_sql("Flipped")


@register("los_density_bounded", O.with_clean(_s, _c))
def q_los_density_bounded(spark, sf_dir):
    """D10 with its error bound; rounded to 11 decimals here, as SQL adds up in another order."""
    d = DI.density_bounded(cleaned_encounters(spark, sf_dir), C.LOS, [C.OUTCOME])
    return d.withColumn("density", fixed("density", 11)).withColumn("error_bound", fixed("error_bound", 11))


@register("stored_model_scores")
def q_stored_model_scores(spark, sf_dir):
    """the fitted models are published as one node table, read back, and score the test rows without a model object."""
    res, _ = M.trained(spark, sf_dir)
    nodes = None
    for name in TR.MODEL_ORDER:
        one = MT.node_table(spark, res.models[(name, None)]).withColumn("model", F.lit(name))
        nodes = one if nodes is None else nodes.unionByName(one)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex[:12]}"
    publish_table(nodes, path, partition_by=["model"])
    stored = read_published(spark, path)
    test = res.data.where(F.col("split") == "test").select(
        C.ID, C.OUTCOME, vector_to_array("features").alias("raw"), vector_to_array("features_z").alias("z"))
    scores = None
    for name in TR.MODEL_ORDER:
        x = F.col("z" if name == TR.LOGISTIC else "raw")
        one = test.select(C.ID, C.OUTCOME, F.lit(name).alias("model"), MT.table_score(stored.where(F.col("model") == name), x).alias("score"))
        scores = one if scores is None else scores.unionByName(one)
    return scores
