"""The cases that caps, switches and defaults once got wrong."""

import pytest
from pyspark.sql import functions as F

from flipwise import config as C
from flipwise.operators import cohort as CO
from flipwise.operators import distribution as DI
from flipwise.operators import evaluate as EV
from flipwise.operators import features as FE
from flipwise.operators.quantile import cut_bucket, group_cuts, sketch_cuts, with_bucket
from flipwise.plans import encounters as EN
from flipwise.plans import models as M
from flipwise.session import ensure_checkpoint_dir
from flipwise.sources.tables import read_csv, write_table


def test_key_filter_takes_the_exact_option_only(spark):
    df = spark.createDataFrame([("Allergic Reaction",), ("Asthma",), ("All Diagnoses of old",)], "d string")
    assert CO.key_filter(df, "d", "Allergic Reaction").count() == 1
    assert CO.key_filter(df, "d", "All Diagnoses of old").count() == 1
    assert CO.key_filter(df, "d", "All Diagnoses").count() == 3
    assert CO.key_filter(df, "d", None).count() == 3


def test_nothing_is_rounded_by_default(spark):
    wide = spark.createDataFrame([(float(i) * 2e10, "a") for i in range(101)], "v double, g string")
    assert DI.density(wide, "v", ["g"]).where("density = 0").count() == 0
    small = spark.createDataFrame([(1e-9 * i, "a") for i in (1, 2)], "v double, g string")
    assert DI.box_stats(small, "v", ["g"]).first()["sd"] == pytest.approx(5e-10)
    curve = EV.score_curve(spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1)], "score double, Flipped int"))
    assert EV.average_precision(curve).first()[0] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3, abs=1e-16)


def test_more_than_a_thousand_levels(spark):
    df = spark.range(1500).select(F.col("id").cast("int").alias("code"))
    assert FE.category_levels(df, "code") == list(range(1500))
    with pytest.raises(ValueError, match="code"):
        FE.category_levels(df, "code", most=1000)


@pytest.mark.parametrize("rare", [True, False])
def test_crowded_scores_spread_over_buckets(spark, rare):
    base = spark.range(200_000)
    df = base.select(((F.col("id") * 7919 % 200_003) / F.lit(2e10 if rare else 1.0) - F.lit(0.0 if rare else 1e5)).alias("score"),
                     (F.col("id") % 3 == 0).cast("int").alias("Flipped"))
    cuts = group_cuts(df, "score", [], EV.N_BUCKETS, bucket_values=100)
    buckets = with_bucket(df, cuts, "score", [], EV.N_BUCKETS).groupBy("__b").count()
    assert buckets.count() > 1000
    assert buckets.agg(F.max("count")).first()[0] < 400
    curve = EV.score_curve(df, state_rows=1000)
    top = curve.orderBy("score").first()
    assert top["tp"] == df.where("Flipped = 1").count() and top["fp"] == df.where("Flipped = 0").count()


def test_bucket_is_monotone(spark):
    df = spark.createDataFrame([(x,) for x in (-1e308, -2.5, -0.0, 0.0, 1.0, 1.0, 1.5, 7.0, 1e308)], "v double")
    cuts = sketch_cuts(df, "v", 4)
    got = [r.b for r in df.select("v", cut_bucket("v", cuts).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)
    assert df.select(cut_bucket("v", [])).distinct().count() == 1


def test_no_exchange_of_rows_on_the_group_alone(spark, sf_small):
    df = EN.cleaned_encounters(spark, sf_small)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64b")
    try:
        for out in (DI.box_summary(df, C.LOS, [C.OUTCOME]), DI.box_outliers(df, C.LOS, [C.OUTCOME], keep=[C.ID]),
                    DI.density(df, C.LOS, [C.OUTCOME])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            for join in [line for line in plan.split("\n") if "SortMergeJoin" in line and "__salt" not in line and "__b" not in line]:
                assert join.count("Flipped") <= 2  # per-group tables, one row a group
            assert "__salt" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_training_layout_depends_on_rows_alone(spark, sf_small):
    assert [M.training_partitions(n) for n in (0, 10, 50_000, 7_000_000, 30_000_000)] == [1, 1, 3, 70, 300]
    split = EN.split_encounters(spark, sf_small)
    old, M.LEAST_ROWS = M.LEAST_ROWS, 500
    try:
        a, _ = M.prepare(split)
        b, _ = M.prepare(split.repartition(13))
    finally:
        M.LEAST_ROWS = old
    assert a.rdd.getNumPartitions() > 1
    layout = lambda d: d.select(F.spark_partition_id().alias("p"), C.ID).groupBy("p").agg(F.collect_list(C.ID).alias("ids")).collect()
    assert {r.p: r.ids for r in layout(a)} == {r.p: r.ids for r in layout(b)}
    a.unpersist()
    b.unpersist()


def test_class_weights_are_those_of_the_rows_fitted(spark):
    counts = {(0, 0): 3, (0, 1): 1, (1, 0): 2, (1, 1): 4}
    df = spark.createDataFrame([(0,), (1,)], "Flipped int")
    weights = lambda k: [r.w for r in df.select(M.class_weight(counts, k).alias("w")).collect()]
    assert weights(None) == [1.0, 1.0]
    assert weights(0) == [6 / 4, 6 / 8]


def test_threshold_can_be_tuned_on_the_folds(spark):
    test = spark.createDataFrame([("m", 0.2, 0), ("m", 0.9, 1), ("m", 0.8, 0)], "model string, score double, Flipped int")
    folds = spark.createDataFrame([("m", 0, 0.1, 0), ("m", 0, 0.5, 1), ("m", 1, 0.2, 0), ("m", 1, 0.5, 1)],
                                  "model string, fold int, score double, Flipped int")
    on = lambda where: M.metrics_table(test, folds, ["m"], tune_on=where).first()["threshold"]
    assert (on("test"), on("validation")) == (0.9, 0.5)


def test_csv_dialect(spark, tmp_path):
    (tmp_path / "in.csv").write_text('code,text,Age\n276,"say ""hi"", ok",40\n276.0,"two\nlines",41\n12x,plain,4.5\n,NA,\n')
    df = read_csv(spark, str(tmp_path / "in.csv"), "code int, text string, Age int", corrupt_col="_corrupt_record").cache()
    rows = [tuple(r) for r in df.collect()]
    assert [r[:3] for r in rows] == [(276, 'say "hi", ok', 40), (276, "two\nlines", 41), (None, "plain", None), (None, None, None)]
    assert df.where(F.col("_corrupt_record").isNotNull()).count() == 1
    write_table(df.select("code", "text"), str(tmp_path / "out"), "csv")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"say ""hi"", ok"' in text
    back = read_csv(spark, str(tmp_path / "out"), "code int, text string")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("code", "text").collect()))


def test_stored_tables_follow_their_input_and_can_be_removed(spark, sf_small, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    read = lambda: EN.stored_once(spark, str(tmp_path), "probe", lambda: spark.read.parquet(str(tmp_path / "t.parquet"))).count()
    assert read() == 3
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert read() == 5
    before = dict(EN._WRITTEN)
    assert EN.forget_stored(spark) == len(before) and not EN._WRITTEN
    assert EN.cleaned_encounters(spark, sf_small).count() > 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
