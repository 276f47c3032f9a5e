"""Profiling, cohort and rounding rules."""

from pyspark.sql import functions as F

from flipwise.functions.numeric import pct, round_half_even
from flipwise.operators import cohort as CO
from flipwise.operators import distribution as DI
from flipwise.operators import profile as PR


def test_rounding_is_half_even_on_scaled_double(spark):
    df = spark.createDataFrame([(0.0125,), (0.0135,), (0.30149999999999999,), (2.675,)], "x double")
    r = [row[0] for row in df.select(pct("x")).collect()]
    # (x*100).round(1): 1.25 -> 1.2, 1.35 -> 1.4 (half to even after scaling), 30.15 -> 30.1/30.2 as numpy
    assert r[0] == 1.2 and r[1] == 1.4
    assert df.select(round_half_even(F.lit(2.5), 0)).first()[0] == 2.0


def test_outcome_rate_drops_null_keys_counts_non_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", None), (None, 1), ("b", 1)], "k string, Flipped int")
    out = {r["k"]: r for r in PR.outcome_rate(df, "k").collect()}
    assert set(out) == {"a", "b"}
    assert out["a"]["Total"] == 2 and out["a"]["Flipped_Count"] == 1 and out["a"]["Flip_Pct"] == 50.0


def test_normalised_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1)], "v double, Flipped int")
    r = PR.vitals_normalised(df, ["v"], ["V"]).first()
    assert r["stayed_norm"] is None and r["flipped_norm"] is None


def test_cohort_null_membership(spark):
    df = spark.createDataFrame([("x", 30.0), (None, 40.0), ("y", None)], "g string, a double")
    assert CO.cohort_filter(df, in_sets={"g": ["x"]}).count() == 1
    assert CO.cohort_filter(df, in_sets={"g": ["x", None]}).count() == 2
    assert CO.cohort_filter(df, in_sets={"g": ["x"]}, include_null={"g": True}).count() == 2
    assert CO.cohort_filter(df, ranges={"a": (30, 40)}).count() == 2    # NULL age dropped
    assert CO.key_filter(df, "g", "All Diagnoses").count() == 3


def test_box_summary_r7_and_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = DI.box_summary(df, "v").first()
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert r["upper_fence"] == 7.0 and r["upper_whisker"] == 4.0 and r["n_outliers"] == 1
    assert DI.box_outliers(df, "v").count() == 1


def test_histogram_nice_width(spark):
    df = spark.createDataFrame([(float(a), a % 2) for a in range(19, 90)], "Age double, Flipped int")
    h = DI.histogram(df, "Age", "Flipped", 20)
    assert {r["bin_end"] - r["bin_start"] for r in h.collect()} == {5.0}
    tot = h.groupBy("Flipped").agg(F.sum("pct").alias("p")).collect()
    assert all(abs(r["p"] - 100.0) < 1e-9 for r in tot)


def test_density_integrates_to_about_one(spark):
    df = spark.createDataFrame([(float(v % 17),) for v in range(500)], "v double")
    d = DI.density(df, "v", n_grid=200).orderBy("point").collect()
    step = d[1]["x"] - d[0]["x"]
    area = sum(r["density"] for r in d) * step
    assert 0.85 < area < 1.05
