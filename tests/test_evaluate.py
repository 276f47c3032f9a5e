"""Evaluation operators against the published goldens, plus rank invariants."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from flipwise.operators import evaluate as EV
from flipwise.operators import risk as RI
from flipwise.operators.rank import two_level_rank

from golden import METRICS, PREDICTIONS, RISK


def preds(spark):
    return spark.createDataFrame(PREDICTIONS, "DRG01 int, score double, Flipped int")


def test_golden_metrics(spark):
    df = preds(spark)
    curve = EV.score_curve(df)
    best = EV.best_f1_threshold(curve).first()
    assert round(best["threshold"], 2) == METRICS["threshold"]
    assert round(best["threshold"], 4) == 0.3188
    auc = EV.roc_auc(curve).first()["roc_auc"]
    assert round(auc, 3) == METRICS["roc_auc"] and abs(auc - 0.622977) < 1e-6
    ap = EV.average_precision(curve).first()["average_precision"]
    assert abs(ap - 0.548735) < 1e-6
    counts = EV.confusion_counts(df, EV.best_f1_threshold(curve))
    rep = {r["class"]: r for r in EV.classification_report(counts).collect()}
    assert round(rep["1"]["precision"], 3) == METRICS["precision"]
    assert round(rep["1"]["recall"], 3) == METRICS["recall"]
    assert round(rep["1"]["f1_score"], 3) == METRICS["f1"]
    assert round(rep["accuracy"]["f1_score"], 3) == METRICS["accuracy"]
    cm = {(r["actual"], r["predicted"]): r["n"] for r in EV.confusion_matrix(counts).collect()}
    assert sum(cm.values()) == 223 and cm[(1, 0)] + cm[(1, 1)] == 103


def test_golden_risk_table(spark):
    got = {r["DRG01"]: r for r in RI.risk_by_key(preds(spark), "DRG01", "score", "Flipped").collect()}
    assert len(got) == 12
    for code, avg, act, cnt, name, avg_pct, act_pct, tier in RISK:
        g = got[code]
        assert abs(g["Avg_Prob"] - avg) < 1e-12 and abs(g["Actual_Rate"] - act) < 1e-12
        assert (g["Count"], g["DiagnosisName"], g["Avg_Prob_Pct"], g["Actual_Pct"], g["Risk_Tier"]) == \
            (cnt, name, avg_pct, act_pct, tier)


def test_curves_match_global_window_with_ties(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([0.0, 0.25, 0.5, 0.5, 0.75, 1.0, rnd.random()]), rnd.randint(0, 1), i % 3)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "score double, Flipped int, m int")
    curve = EV.score_curve(df, by=["m"], n_buckets=8, state_rows=10)   # coarse buckets: many scores per bucket
    g = df.groupBy("m", "score").agg(F.sum("Flipped").alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy("m").orderBy(F.col("score").desc())
    ref = g.select("m", "score", F.sum("pos").over(w).alias("tp"),
                   F.sum(F.col("n") - F.col("pos")).over(w).alias("fp"))
    diff = curve.select("m", "score", "tp", "fp").exceptAll(ref).count()
    assert diff == 0
    # ROC starts at (0,0) and ends at (1,1) per group; AUC in [0,1]
    roc = EV.roc_curve(curve, by=["m"])
    ends = roc.groupBy("m").agg(F.max("fpr").alias("f"), F.max("tpr").alias("t")).collect()
    assert all(r["f"] == 1.0 and r["t"] == 1.0 for r in ends)
    assert all(0 <= r["roc_auc"] <= 1 for r in EV.roc_auc(curve, ["m"]).collect())


def test_two_level_rank_equals_global(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, rnd.randint(0, 1), rnd.randint(0, 50)) for i in range(2000)],
                               "id long, s int, v int")
    got = two_level_rank(df, ["s"], [F.col("v"), F.col("id")], (F.col("v") / 10).cast("int"))
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy("v", "id")) - 1)
    assert got.select("id", "rank").exceptAll(ref.select("id", F.col("rank").cast("bigint"))).count() == 0
