"""Distributed exact quantiles equal the built-in exact percentile."""

import random

from pyspark.sql import functions as F

from flipwise.operators.quantile import collapse, exact_median, exact_quantiles, group_cuts, with_bucket


def _builtin(df, probs, groups):
    return df.groupBy(*groups).agg(F.percentile("v", probs).alias("q"))


def test_small_groups_equal_builtin(spark):
    rnd = random.Random(11)
    rows = [(g, float(rnd.randint(0, 30)) if g != "c" else rnd.random()) for g in "abc" for _ in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.25, 0.5, 0.75]
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for r in _builtin(df, probs, ["g"]).collect():
        for p, q in zip(probs, r["q"]):
            assert got[(r["g"], p)] == q


def test_bracket_path_equals_builtin(spark):
    # accuracy far below the group size forces the sketch bracket path
    df = spark.range(20000).select((F.col("id") % 3).alias("g"),
                                   ((F.col("id") * 7919) % 10007 / 7.0).alias("v"))
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, "v", probs, ["g"], n_buckets=7, state_values=100, bucket_values=100).collect()}
    for r in _builtin(df, probs, ["g"]).collect():
        for p, q in zip(probs, r["q"]):
            assert got[(r["g"], p)] == q
    m = exact_median(df, "v", n_buckets=16, state_values=100).first()["median"]
    assert m == df.agg(F.median("v")).first()[0]


def test_distributed_options_match_exact(spark, sf_small):
    from flipwise import config as C
    from flipwise.operators import clean as CL
    from flipwise.operators import distribution as DI
    from flipwise.operators import profile as PR
    from flipwise.plans.encounters import cleaned_encounters
    from flipwise.sources.fixtures import raw_encounters
    rep = CL.repair_vitals(raw_encounters(spark, sf_small))
    a = CL.median_row(rep, C.IMPUTED_VITALS, "exact").first().asDict()
    b = CL.median_row(rep, C.IMPUTED_VITALS, "distributed").first().asDict()
    assert a == b
    df = cleaned_encounters(spark, sf_small)
    x = DI.box_summary(df, C.LOS, [C.DIAGNOSIS], method="exact")
    y = DI.box_summary(df, C.LOS, [C.DIAGNOSIS], method="distributed").select(*x.columns)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0
    m1 = PR.median_order(df, method="exact")
    m2 = PR.median_order(df, method="distributed").select(*m1.columns)
    assert m1.exceptAll(m2).count() == 0


def test_groups_of_different_scale_are_cut_evenly(spark):
    """20,000 values up to 1 beside 400,000 up to 1e9: every bucket holds at most twice its group's mean, the values are the built-in ones."""
    big = spark.range(400_000).select(F.lit("big").alias("g"), ((F.col("id") * 7919 % 400_009) * 2500.0 + 1).alias("v"))
    small = spark.range(20_000).select(F.lit("small").alias("g"), ((F.col("id") * 7919 % 20_011) / 20_011.0).alias("v"))
    df = big.unionByName(small)
    values = collapse(df, "v", ["g"])
    cut = with_bucket(values, group_cuts(values, "__v", ["g"], bucket_values=500), "__v", ["g"])
    for r in cut.groupBy("g", "__b").count().groupBy("g").agg(F.max("count").alias("most"), F.avg("count").alias("mean"), F.count("count").alias("n")).collect():
        assert r.most <= 2 * r.mean and r.n >= (30 if r.g == "small" else 400)
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, "v", probs, ["g"], state_values=1000, bucket_values=500).collect()}
    assert got == {(r["g"], p): q for r in _builtin(df, probs, ["g"]).collect() for p, q in zip(probs, r["q"])}


def test_one_distinct_value_and_no_values(spark):
    df = spark.createDataFrame([("a", 1.0)] * 30 + [("b", None)], "g string, v double")
    for state in (0, 100):
        assert [tuple(r) for r in exact_quantiles(df, "v", [0.5], ["g"], state_values=state, bucket_values=1).collect()] == [("a", 0.5, 1.0)]
        assert exact_quantiles(df.limit(0), "v", [0.5], state_values=state).collect() == []
