"""Stratified split and folds (F2, F3, F15) on the small driver table."""

import math

from pyspark.sql import functions as F

from flipwise.operators import split as SP
from flipwise.plans.encounters import cleaned_encounters


def test_split_is_exact_per_class_and_stable(spark, sf_small):
    d = SP.assign_split(cleaned_encounters(spark, sf_small)).cache()
    per = {(r["Flipped"], r["split"]): r["n"] for r in
           d.groupBy("Flipped", "split").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        n = per[(y, "test")] + per[(y, "train")]
        assert per[(y, "test")] == math.ceil(0.2 * n)
    folds = d.where("fold IS NOT NULL").groupBy("Flipped", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r["Flipped"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = SP.assign_split(cleaned_encounters(spark, sf_small))
    assert d.select("encounter_id", "split", "fold").exceptAll(
        again.select("encounter_id", "split", "fold")).count() == 0


def test_standardise_uses_training_stats(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (10.0, "test"), (5.0, "train")], "x double, split string")
    out = {r["x"]: r["x_z"] for r in SP.standardise(df, ["x"], F.col("split") == "train", suffix="_z").collect()}
    mean, sd = 3.0, math.sqrt(8 / 3)   # population sd of 1, 3, 5
    assert abs(out[10.0] - (10.0 - mean) / sd) < 1e-12
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in SP.standardise(const, ["x"]).collect()] == [0.0, 0.0]
