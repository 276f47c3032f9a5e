"""Exact sums, densities and curves with error columns, models as tables."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flipwise import config as C
from flipwise.functions.exact_sum import exact_sums, limb_totals, sums_of
from flipwise.operators import distribution as DI
from flipwise.operators import evaluate as EV
from flipwise.operators import model_table as MT
from flipwise.plans import models as M
from flipwise.plans import registry_multi as RM
from flipwise.plans.encounters import cleaned_encounters, split_encounters
from flipwise.plans.registry_exact import EXACT_QUERIES


def bits(df):
    """Rows with doubles written out in full."""
    return sorted(tuple(v.hex() if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def hard_values():
    r = random.Random(5)
    rows = []
    for _ in range(400):
        rows += [(0, r.gauss(0, 1)), (1, r.gauss(0, 1) * 10.0 ** r.randint(-30, 30)), (2, -r.random() * 10.0 ** r.randint(-200, 200)), (3, 0.0),
                 (4, r.uniform(-1, 1) * 2.0 ** r.randint(-1000, -940)), (5, float(2 ** 53 - r.randint(0, 9)) * r.choice([-1, 1]))]
    rows += [(6, 0.5), (6, -0.5), (7, 1.0), (7, 2.0 ** -53), (7, 2.0 ** -300), (8, 1.0), (8, 2.0 ** -53), (9, None), (9, -3.25), (10, 1e16), (10, 1.0), (10, -1e16)]
    return rows


@pytest.mark.parametrize("n", [1, 50])
def test_sums_are_rounded_once(spark, n):
    rows = hard_values()
    df = spark.createDataFrame(rows, "g int, x double").repartition(n)
    got = {r.g: (r.a, r.b) for r in exact_sums(df, {"a": F.col("x"), "b": -F.col("x")}, ["g"]).collect()}
    for g in {g for g, _ in rows}:
        expected = math.fsum(x for h, x in rows if h == g and x is not None)
        assert got[g] == (expected, -expected)


def test_sums_of_special_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None), (1, inf), (1, 1.0), (2, -inf), (2, 1.0), (3, inf), (3, -inf), (4, nan), (4, 1.0), (5, 1e308), (5, 1e308), (None, 2.0)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.a for r in exact_sums(df, {"a": F.col("x")}, ["g"]).collect()}
    assert got[0] is None and got[1] == inf and got[2] == -inf and got[5] == inf and got[None] == 2.0
    assert math.isnan(got[3]) and math.isnan(got[4])
    empty = df.where(F.lit(False))
    assert exact_sums(empty, {"a": F.col("x")}, ["g"]).collect() == []
    assert exact_sums(empty, {"a": F.col("x")}).collect()[0].a is None


def test_weighted_sums_and_states_add_up(spark):
    rows = [(i % 3, math.sin(i) * 10.0 ** (i % 20 - 10), i * 7919 % 1000) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, x double, w bigint")
    total = exact_sums(df, {"a": F.col("x")}, ["g"], F.col("w"))
    from fractions import Fraction
    for r in total.collect():
        assert r.a == float(sum(Fraction(x) * w for g, x, w in rows if g == r.g))
    half = lambda k: limb_totals(df.where(F.col("w") % 2 == k), {"a": F.col("x")}, ["g"], F.col("w"))
    merged = half(0).unionByName(half(1)).groupBy("g", "__k", "__limb").agg(F.sum("__total").cast("decimal(38,0)").alias("__total"))
    assert bits(sums_of(merged, ["a"], ["g"])) == bits(total)


def test_statistics_do_not_depend_on_the_partitioning(spark):
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("g"), (F.sin("id") * F.exp(F.col("id") % 9)).alias("v"),
                                  (F.col("id") % 5 == 0).cast("int").alias(C.OUTCOME), F.sqrt(F.col("id") % 1777).alias("score"))
    runs = []
    for n in (1, 50):
        d = df.repartition(n)
        runs.append([bits(DI.exact_moments(d, "v", ["g"])), bits(DI.density_bounded(d, "v", ["g"], n_grid=9, n_bins=16)),
                     bits(EV.average_precision_exact(EV.score_curve(d, by=["g"]), ["g"]))])
    assert runs[0] == runs[1]
    values = np.array([r.v for r in df.where("g = 1").collect()])
    got = {r.g: r for r in DI.exact_moments(df, "v", ["g"]).collect()}[1]
    assert got["sum"] == math.fsum(values) and got["n"] == 2000
    assert math.isclose(got["sd"], values.std(), rel_tol=1e-13)
    ap = EV.average_precision(EV.score_curve(df)).first()[0]
    assert math.isclose(EV.average_precision_exact(EV.score_curve(df)).first()[0], ap, rel_tol=1e-13)


@pytest.mark.parametrize("n_bins", [8, 64, 256])
def test_density_bound_holds_against_the_direct_sum(spark, sf_small, n_bins):
    rows = cleaned_encounters(spark, sf_small).select(C.OUTCOME, C.LOS)
    binned = {(r[C.OUTCOME], r.point): r for r in DI.density_bounded(rows, C.LOS, [C.OUTCOME], n_bins=n_bins).collect()}
    con = duckdb.connect()
    con.register("clean", rows.toPandas())
    direct = con.execute(
        f"WITH st AS (SELECT {C.OUTCOME} AS g, COUNT(*) AS n, MIN({C.LOS}) AS lo, MAX({C.LOS}) AS hi, stddev_pop({C.LOS}) AS sd,"
        f" quantile_cont({C.LOS}, 0.75) - quantile_cont({C.LOS}, 0.25) AS iqr FROM clean GROUP BY 1),"
        " h AS (SELECT *, 0.9 * LEAST(sd, iqr / 1.34) * pow(n, -0.2) AS h FROM st),"
        " gr AS (SELECT *, lo + p * (hi - lo) / 63.0 AS x FROM h, range(0, 64) t(p))"
        f" SELECT g, p, SUM(exp(-0.5 * pow((x - {C.LOS}) / h, 2))) / (n * h * sqrt(2 * pi())) FROM gr JOIN clean ON g = {C.OUTCOME} GROUP BY g, p, n, h").fetchall()
    assert len(direct) == len(binned) == 128
    off = [abs(binned[g, p].density - d) / binned[g, p].error_bound for g, p, d in direct]
    assert max(off) <= 1.0 + 1e-9 and max(off) > 0.01


def test_density_of_constant_and_empty_groups(spark):
    df = spark.createDataFrame([(0, 3.0), (0, 3.0), (1, None)], "g int, v double")
    got = DI.density_bounded(df, "v", ["g"], n_grid=3).collect()
    assert {r.g for r in got} == {0} and all(r.error_bound == 0 and r.x == 3.0 for r in got)
    assert DI.density_bounded(df.where("g = 1"), "v", ["g"]).count() == 0


@pytest.mark.parametrize("k", [4, 33, 100, 5000])
def test_bounded_curves(spark, sf_small, k):
    curve = EV.score_curve(RM._scored(spark, sf_small)[0], by=["model"]).cache()
    for name, exact, bounded, x, y in [("roc", EV.roc_curve(curve, by=["model"], drop_intermediate=False), EV.roc_curve_bounded(curve, k, by=["model"]), "fpr", "tpr"),
                                       ("pr", EV.pr_curve(curve, by=["model"]), EV.pr_curve_bounded(curve, k, by=["model"]), "recall", "precision")]:
        full, kept = exact.collect(), bounded.collect()
        for m in RM.SCORES:
            every = sorted(((r[x], r[y], r.threshold) for r in full if r.model == m and r.threshold is not None), key=lambda p: -p[2])
            mine = sorted(((r[x], r[y], r.threshold, r.error, r.error_bound) for r in kept if r.model == m and r.threshold is not None), key=lambda p: -p[2])
            assert len(mine) + 1 == len([r for r in kept if r.model == m]) <= k
            assert {p[:3] for p in mine} <= set(every) and mine[0][:3] == every[0] and mine[-1][:3] == every[-1]
            assert all(p[3] <= p[4] + 1e-12 for p in mine)
            place = {p[2]: i for i, p in enumerate(every)}
            worst = 0.0
            for a, b in zip(mine, mine[1:]):
                for p in every[place[a[2]] + 1:place[b[2]]]:
                    if b[0] != a[0]:
                        worst = max(worst, abs(p[1] - (a[1] + (b[1] - a[1]) * ((p[0] - a[0]) / (b[0] - a[0])))))
            assert math.isclose(worst, max(p[3] for p in mine), abs_tol=1e-12), name
            if k == 5000 and name == "roc":
                assert worst < 0.01
    curve.unpersist()


def test_bounded_curves_of_one_class(spark):
    curve = EV.score_curve(spark.createDataFrame([(0.5, 1), (0.25, 1)], f"score double, {C.OUTCOME} int"))
    assert EV.roc_curve_bounded(curve).count() == 0
    assert [r.precision for r in EV.pr_curve_bounded(curve).collect()] == [1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        EV.roc_curve_bounded(curve, 3)


@pytest.fixture(scope="module")
def small_models(spark, sf_small):
    small = {"Random Forest": dict(numTrees=9, maxDepth=5), "Gradient Boosting": dict(maxIter=6, maxDepth=3)}
    return M.train_and_score(split_encounters(spark, sf_small), overrides=small, parallelism=4, n_folds=1)


def test_stored_model_scores(spark, sf_small, small_models, monkeypatch):
    """The registered query, on small ensembles: tables published, read back and scored."""
    monkeypatch.setattr(M, "trained", lambda spark, sf_dir: (small_models, None))
    stored = EXACT_QUERIES["stored_model_scores"](spark, sf_small)
    both = stored.withColumnRenamed("score", "mine").join(small_models.test_scores.select(C.ID, "model", "score"), [C.ID, "model"])
    n, off = both.agg(F.count("mine"), F.max(F.abs(F.col("mine") - F.col("score")))).first()
    assert n == stored.count() == small_models.test_scores.count() and off <= 1e-12


def test_model_tables_score_like_the_models(spark, small_models):
    res = small_models
    test = res.data.where(F.col("split") == "test")
    for name in M.TR.MODEL_ORDER:
        nodes = MT.node_table(spark, res.models[(name, None)])
        assert nodes.columns == ["kind", "tree", "node", "feature", "threshold", "left", "right", "value"]
        vector = "features_z" if name == M.TR.LOGISTIC else "features"
        mine = test.select(C.ID, vector_to_array(vector).alias("x")).withColumn("mine", MT.table_score(nodes, F.col("x")))
        both = mine.join(res.test_scores.where(F.col("model") == name), C.ID)
        n, off, distinct = both.agg(F.count("mine"), F.max(F.abs(F.col("mine") - F.col("score"))), F.countDistinct("mine")).first()
        assert n == test.count() and off <= 1e-12 and distinct > 10


def test_model_tables_by_hand(spark):
    rows = [("boosting", 0, 0, 1, 2.0, 1, 2, None), ("boosting", 0, 1, None, None, None, None, -0.5), ("boosting", 0, 2, 0, 0.0, 3, 4, None),
            ("boosting", 0, 3, None, None, None, None, 0.25), ("boosting", 0, 4, None, None, None, None, 1.0), ("boosting", 1, 0, None, None, None, None, 0.125)]
    nodes = spark.createDataFrame(rows, MT.COLUMNS)
    data = spark.createDataFrame([([0.0, 2.0],), ([0.0, 2.5],), ([0.5, 3.0],), ([float("nan"), float("nan")],)], "x array<double>")
    got = [r[0] for r in data.select(MT.table_score(nodes, F.col("x"))).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-2 * m)) for m in (-0.375, 0.375, 1.125, 1.125)], abs=1e-15)
    with pytest.raises(ValueError):
        MT.table_score(nodes.limit(0), F.col("x"))
    with pytest.raises(ValueError):
        MT.table_score(nodes.unionByName(nodes.withColumn("kind", F.lit("forest"))), F.col("x"))
