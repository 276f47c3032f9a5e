"""Model queries (trained estimators: rows-only check, no SQL oracle)."""

from __future__ import annotations


from . import models as M

MODEL_QUERIES = {}


def register(name):
    def deco(fn):
        MODEL_QUERIES[name] = fn
        return fn
    return deco


@register("model_metrics")
def q_model_metrics(spark, sf_dir):
    return M.trained(spark, sf_dir)[1]


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    return M.comparison_table(M.trained(spark, sf_dir)[1])


@register("model_auc_bar")
def q_model_auc_bar(spark, sf_dir):
    return M.auc_from_text(M.comparison_table(M.trained(spark, sf_dir)[1]))


@register("best_model")
def q_best_model(spark, sf_dir):
    return M.best_model(M.trained(spark, sf_dir)[1])


@register("cv_fold_auc")
def q_cv_fold_auc(spark, sf_dir):
    return M.cv_fold_auc(M.trained(spark, sf_dir)[0])


@register("feature_importance_top20")
def q_feature_importance_top20(spark, sf_dir):
    return M.feature_importance(M.trained(spark, sf_dir)[0])


@register("drg_risk_scored")
def q_drg_risk_scored(spark, sf_dir):
    res, metrics = M.trained(spark, sf_dir)
    return M.scored_risk(res, metrics).orderBy("Avg_Prob_Pct", "DRG01")


@register("test_predictions")
def q_test_predictions(spark, sf_dir):
    res, metrics = M.trained(spark, sf_dir)
    return M.test_predictions(res, metrics)


@register("model_confusion_matrix")
def q_model_confusion_matrix(spark, sf_dir):
    from .. import config as C
    from ..operators import evaluate as EV
    res, _ = M.trained(spark, sf_dir)
    curve = EV.score_curve(res.test_scores, C.OUTCOME, "score", ["model"])
    best = EV.best_f1_threshold(curve, "score", ["model"])
    return EV.confusion_matrix(EV.confusion_counts(res.test_scores, best, C.OUTCOME, "score", ["model"]),
                               ["model"])


@register("model_roc_curves")
def q_model_roc_curves(spark, sf_dir):
    from .. import config as C
    from ..operators import evaluate as EV
    res, _ = M.trained(spark, sf_dir)
    return EV.roc_curve(EV.score_curve(res.test_scores, C.OUTCOME, "score", ["model"]), "score", ["model"])
