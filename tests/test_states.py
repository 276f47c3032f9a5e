"""Curve states, the cohort cube, profiles over grouping sets, inferred types, published tables."""

import pytest
from pyspark.sql import functions as F

from flipwise import config as C
from flipwise.operators import cohort as CO
from flipwise.operators import cube as CU
from flipwise.operators import evaluate as EV
from flipwise.operators import profile as PR
from flipwise.plans import encounters as EN
from flipwise.plans import models as M
from flipwise.plans import registry_multi as RM
from flipwise.sources.tables import (current_version, drop_versions, inferred_kinds, kind_type, publish_table, read_csv, read_published)


def rows(df):
    return sorted(map(str, map(tuple, df.select(*sorted(df.columns)).collect())))


def scans(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count("FileScan")


def test_curve_state_adds_up_and_is_scanned_once(spark, sf_small):
    test, folds = RM._scored(spark, sf_small)
    whole = M.curve_state(test, folds)
    half = lambda d, k: d.where(F.col(C.ID) % 2 == k)
    parts = [M.curve_state(half(test, k), half(folds, k)) for k in (0, 1)]
    assert rows(EV.merge_counts(*parts, by=["model", "fold"])) == rows(whole)
    assert scans(M.state_metrics(RM._state(spark, sf_small), RM.SCORES)) <= 2


def test_metrics_equal_single_metrics(spark, sf_small):
    test, folds = RM._scored(spark, sf_small)
    got = {r.model: r for r in M.metrics_table(test, folds, RM.SCORES).collect()}
    curve = EV.score_curve(test, by=["model"]).cache()
    best = EV.best_f1_threshold(curve, by=["model"])
    report = {(r.model, r["class"]): r for r in EV.classification_report(EV.confusion_counts(test, best, by=["model"]), ["model"]).collect()}
    for r in best.join(EV.roc_auc(curve, ["model"]), "model").join(EV.average_precision(curve, ["model"]), "model").collect():
        m = got[r.model]
        assert (m.threshold, m.roc_auc, m.precision_1, m.recall_1) == (r.threshold, r.roc_auc, r.precision, r.recall)
        assert m.average_precision == pytest.approx(r.average_precision, abs=1e-12)
        assert (m.f1_1, m.accuracy) == (report[r.model, "1"].f1_score, report[r.model, "accuracy"].f1_score)


def test_curve_paths_are_equal(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("m"), (F.col("id") * 7919 % 611 / F.lit(7.0)).alias("score"),
                                  (F.col("id") % 5 == 0).cast("int").alias("Flipped"))
    assert rows(EV.score_curve(df, by=["m"])) == rows(EV.score_curve(df, by=["m"], state_rows=5, n_buckets=16))
    assert rows(EV.score_curve(df)) == rows(EV.score_curve(df, state_rows=5, n_buckets=16))


def test_cube_equals_rows_for_other_cohorts(spark, sf_small):
    df, cube = EN.cleaned_encounters(spark, sf_small), RM.cohort_cube(spark, sf_small)
    for cohort in ({}, {"ranges": {C.AGE: (19, 60)}}, {"in_sets": {C.DIAGNOSIS: ["Pneumonia", None], C.GENDER: ["Male"]}},
                   {"in_sets": {C.GENDER: ["nobody"]}}):
        cells, part = CO.cohort_filter(cube, **cohort), CO.cohort_filter(df, **cohort)
        assert rows(CU.rates(cells, [C.INSURANCE, C.GENDER])) == rows(PR.outcome_rate(part, [C.INSURANCE, C.GENDER]))
        assert rows(CU.kpis(cells)) == rows(PR.kpi_summary(part))
        assert rows(CU.flag_prevalence(cells)) == rows(PR.flag_prevalence(part))


def test_cube_is_additive_and_reads_no_encounter(spark, sf_small):
    df = EN.cleaned_encounters(spark, sf_small)
    parts = [CU.cohort_cube(df.where(F.col(C.ID) % 3 == k)) for k in range(3)]
    assert rows(CU.merge(*parts)) == rows(CU.cohort_cube(df))
    for name in ("cube_cohort_rates", "cube_cohort_kpis", "cube_cohort_flags", "cube_cohort_age_histogram"):
        plan = str(RM.MULTI_QUERIES[name](spark, sf_small)._jdf.queryExecution().optimizedPlan()) + \
            "".join(RM.MULTI_QUERIES[name](spark, sf_small).inputFiles())
        assert "cohort-cube" in plan and "cleaned-encounters" not in plan
        assert "PushedFilters: [" in str(RM.MULTI_QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan())


def test_profiles_of_one_scan(spark, sf_small):
    df = EN.cleaned_encounters(spark, sf_small)
    out = PR.outcome_profiles(df, RM.PROFILES)
    assert scans(out) == 1
    for name, keys in RM.PROFILES.items():
        one = PR.outcome_rate(df, keys)
        assert rows(out.where(F.col("profile") == name).select(*one.columns)) == rows(one)
    all_rows = PR.outcome_profiles(df, {"all": [], "gender": [C.GENDER]}).where("profile = 'all'").first()
    assert all_rows.Total == df.where(F.col(C.OUTCOME).isNotNull()).count()


def test_inferred_types_follow_the_tokens(spark, tmp_path):
    cells = {"i": ["1", " 2", "-3", "+4"], "i_na": ["1", "NA", "3", ""], "big": ["1", "99999999999999999999", "3", "4"], "d": ["1", "2.5", "1e3", "-.5"],
             "inf": ["inf", "-inf", "1", "Infinity"], "b": ["True", "FALSE", "true", "False"], "b_na": ["True", "", "true", "False"],
             "mix": ["1", "True", "0", "1"], "t": ["1", "2", "x", "4"], "none": ["", "NaN", "null", "N/A"], "date": ["2020-01-01"] * 4}
    lines = [",".join(cells)] + [",".join(cells[c][k] for c in cells) for k in range(4)]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    df = read_csv(spark, str(tmp_path / "m.csv"))
    assert dict(df.dtypes) == {"i": "bigint", "i_na": "double", "big": "double", "d": "double", "inf": "double", "b": "boolean", "b_na": "string",
                               "mix": "string", "t": "string", "none": "double", "date": "string"}
    got = df.collect()
    assert [r.i for r in got] == [1, 2, -3, 4] and [r.i_na for r in got] == [1.0, None, 3.0, None]
    assert [r.d for r in got] == [1.0, 2.5, 1000.0, -0.5] and [r.b for r in got] == [True, False, True, False]
    assert [r.inf for r in got] == [float("inf"), float("-inf"), 1.0, float("inf")] and [r.none for r in got] == [None] * 4
    import pandas as pd
    pandas = pd.read_csv(tmp_path / "m.csv", true_values=None)
    names = {"bigint": "int64", "double": "float64", "boolean": "bool"}
    for c, t in df.dtypes:
        if c != "big":  # beyond 64 bits: a double here
            assert str(pandas[c].dtype) == names.get(t, str(pandas["t"].dtype)), c


def test_inference_of_an_empty_file_and_odd_names(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b.c\n")
    assert read_csv(spark, str(tmp_path / "e.csv")).dtypes == [("a", "double"), ("b.c", "double")]
    assert [r.kinds for r in inferred_kinds(spark.createDataFrame([("1",), ("x",)], "v string")).collect()] == [20]
    assert kind_type(0) == "double"


def test_readers_never_see_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "t")
    first = publish_table(spark.range(10), path)
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    held = read_published(spark, path)
    with pytest.raises(Exception, match="broken"):
        publish_table(broken, path)
    assert current_version(spark, path) == first and read_published(spark, path).count() == 10
    second = publish_table(spark.range(20), path)
    assert (current_version(spark, path), read_published(spark, path).count(), held.count()) == (second, 20, 10)
    assert drop_versions(spark, path) >= 1 and read_published(spark, path).count() == 20
