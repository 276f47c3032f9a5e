"""Trained models: invariants on the small tables with small ensembles."""

from pyspark.sql import functions as F

from flipwise.plans import models as M
from flipwise.plans.encounters import split_encounters

SMALL = {"Random Forest": dict(numTrees=8, maxDepth=4), "Gradient Boosting": dict(maxIter=5, maxDepth=3)}


def test_train_evaluate_invariants(spark, sf_small):
    res = M.train_and_score(split_encounters(spark, sf_small), overrides=SMALL, parallelism=4)
    met = {r["model"]: r for r in M.model_metrics(res).collect()}
    assert set(met) == {"Logistic Regression", "Random Forest", "Gradient Boosting"}
    for r in met.values():
        assert 0.0 <= r["roc_auc"] <= 1.0 and 0.0 <= r["cv_auc_mean"] <= 1.0
        assert r["cv_auc_sd"] >= 0.0 and 0.0 < r["threshold"] < 1.0
    imp = M.feature_importance(res)
    full = res.models[("Random Forest", None)].featureImportances.toArray()
    assert abs(sum(full) - 1.0) < 1e-9
    assert imp.groupBy("model").count().where("count > 20").count() == 0
    table = M.comparison_table(M.model_metrics(res)).collect()
    assert [r["Model"] for r in table] == ["Logistic Regression", "Random Forest", "Gradient Boosting"]
    assert "±" in table[0]["CV-AUC (5-fold)"]
    bars = {r["Model"]: r["auc"] for r in M.auc_from_text(M.comparison_table(M.model_metrics(res))).collect()}
    assert all(abs(bars[m] - met[m]["roc_auc"]) <= 0.0005 for m in bars)
    n_test = res.data.where(F.col("split") == "test").count()
    assert res.test_scores.count() == 3 * n_test
    risk = M.scored_risk(res, M.model_metrics(res))
    assert risk.agg(F.sum("Count")).first()[0] == n_test
