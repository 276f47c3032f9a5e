"""Training and evaluation plan: three classifiers, hold-out and k-fold metrics,
importances and risk from the best model (F1-F22).

Plan:

1. the stored split table -> one-hot features -> training-median fill of the
   columns with NULLs, standardised copy (training statistics) and vectors,
   laid out by a hash of the id; every fit reads this table;
2. the final fits (training rows) and the k-fold fits (training rows minus
   one fold) are independent Spark jobs submitted from a thread pool, so the
   cluster runs them concurrently;
3. all test scores (and all fold scores) form one DataFrame keyed by model
   (and fold); every metric is computed from it with the distributed
   evaluation operators, grouped by model.
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import fixed
from ..functions.text import extract_number, fixed_text, mean_sd_text, pretty_feature
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import risk as RI
from ..operators import split as SP
from ..operators import train as TR
from .encounters import split_encounters

KEEP = [C.ID, C.CODE, C.AGE, C.OUTCOME]


@dataclass
class TrainResult:
    data: DataFrame
    features: list[str]
    n_train: int
    models: dict = field(default_factory=dict)
    test_scores: DataFrame | None = None
    fold_scores: DataFrame | None = None


#: Rows of a partition of the training table: so many, up to SPREAD partitions; beyond those partitions stay as many until each holds MOST_ROWS.
LEAST_ROWS, MOST_ROWS, SPREAD = 20_000, 100_000, 40


def training_partitions(n_rows: int) -> int:
    """Partitions of the training table, from its rows alone: seeded fits depend
    on the layout, so it must not depend on the cluster."""
    return max(1, min(SPREAD, -(-n_rows // LEAST_ROWS)), -(-n_rows // MOST_ROWS))


def prepare(split_table: DataFrame, label: str = C.OUTCOME) -> tuple[DataFrame, list[str]]:
    """Step 1, from the stored split table: features, fill, standardisation and vectors.

    Rows go to partitions by a hash of their id and lie in order of id, so the
    fits see the same layout on any cluster.  Columns without NULLs are not
    filled; the others get the exact median of the training rows.
    """
    d, feats = FE.model_features(split_table)
    d = d.select(*KEEP, "split", "fold", *[f for f in feats if f not in KEEP])
    is_train = F.col("split") == "train"
    d = TR.fill_with_fit_median(d, feats, is_train)
    z = [f"{c}__z" for c in feats]
    d = SP.standardise(d, feats, is_train, suffix="__z", binary=binary_features(feats))
    d = TR.assemble(d, feats, "features")
    d = TR.assemble(d, z, "features_z")
    d = d.select(*KEEP, "split", "fold", "features", "features_z")
    d = d.repartition(training_partitions(split_table.count()), F.xxhash64(C.ID)).sortWithinPartitions(C.ID)
    # Kept for the many passes of the fits; a lost block is read again from the stored split table.
    return d.persist(StorageLevel.MEMORY_AND_DISK), feats


def binary_features(feats: list[str]) -> list[str]:
    """The 0/1 columns among the model features."""
    return [f for f in feats if f.startswith(("Ins_", "DRG_", "Flag_")) or f == C.GENDER_BINARY]


def _fit_all(jobs, parallelism: int):
    lock = threading.Lock()
    out = {}

    def run(key, est, train):
        m = est.fit(train)
        with lock:
            out[key] = m

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        futs = [ex.submit(run, k, e, t) for k, e, t in jobs]
        for f in futs:
            f.result()
    return out


def class_weight(counts: dict[tuple, int], without: int | None, label: str = C.OUTCOME):
    """Balanced weight of a row's class, n / (classes x n of the class), over the
    training rows outside fold ``without`` (each fit weighs its own rows)."""
    held: dict[int, int] = {}
    for (fold, y), n in counts.items():
        if fold != without:
            held[y] = held.get(y, 0) + n
    total, out = sum(held.values()), F.lit(1.0)
    for y, n in held.items():
        out = F.when(F.col(label) == y, F.lit(total / (len(held) * n))).otherwise(out)
    return out


def train_and_score(split_table: DataFrame, names: list[str] | None = None, n_folds: int = C.N_FOLDS,
                    parallelism: int = 8, overrides: dict | None = None) -> TrainResult:
    """Steps 1-2: fit every model on the training rows and on each k-fold
    complement; score the test rows and each held-out fold.

    ``split_table`` is the cleaned table with ``split`` and ``fold``.  Class
    weights are those of the rows that a fit sees; fill values and scaling come
    from all training rows, also for the folds (a quirk kept for the scaling).
    """
    names = TR.MODEL_ORDER if names is None else names
    overrides = overrides or {}
    data, feats = prepare(split_table)
    train = data.where(F.col("split") == "train")
    # Rows per (fold, class), at most 2 k small rows: weights, and the LR penalty, which scales with the rows fitted.
    counts = {(r["fold"], r[C.OUTCOME]): r["n"]
              for r in train.groupBy("fold", C.OUTCOME).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train = int(sum(counts.values()))
    jobs = []
    for name in names:
        over = overrides.get(name, {})
        for k in [None, *range(n_folds)]:
            n_part = n_train - sum(n for (fold, _), n in counts.items() if k is not None and fold == k)
            rows = train if k is None else train.where(F.col("fold") != k)
            jobs.append(((name, k), TR.estimator(name, n_part, C.OUTCOME, **over), rows.withColumn("class_weight", class_weight(counts, k))))
    # Longest fits first (boosting is sequential in its rounds), so the pool
    # never ends with one long job running alone.
    rank = {TR.BOOSTING: 0, TR.FOREST: 1, TR.LOGISTIC: 2}
    jobs.sort(key=lambda j: rank.get(j[0][0], 3))
    models = _fit_all(jobs, parallelism)
    test = data.where(F.col("split") == "test")
    scored = None
    folds = None
    for name in names:
        s = TR.score(models[(name, None)], test, KEEP).withColumn("model", F.lit(name))
        scored = s if scored is None else scored.unionByName(s)
        for k in range(n_folds):
            fs = (TR.score(models[(name, k)], train.where(F.col("fold") == k), [C.OUTCOME])
                  .withColumn("model", F.lit(name)).withColumn("fold", F.lit(k)))
            folds = fs if folds is None else folds.unionByName(fs)
    # Scores are reused by every metric; keep them (recomputable from the
    # stored split table and the fitted models if an executor is lost).
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    folds = folds.persist(StorageLevel.MEMORY_AND_DISK)
    return TrainResult(data, feats, n_train, models, scored, folds)


#: Fold number of the test rows in a curve state.
TEST = -1


def curve_state(test_scores: DataFrame, fold_scores: DataFrame) -> DataFrame:
    """(model, fold, score, pos, neg) of test rows (fold ``TEST``) and held-out folds: all that the metrics need.

    Additive: the state of more rows is added with ``evaluate.merge_counts``.
    """
    cols = ["model", "fold", "score", C.OUTCOME]
    rows = test_scores.withColumn("fold", F.lit(TEST)).select(*cols).unionByName(fold_scores.withColumn("fold", F.col("fold").cast("int")).select(*cols))
    return EV.score_counts(rows, C.OUTCOME, "score", ["model", "fold"])


def state_metrics(state: DataFrame, order: list[str], tune_on: str = "test", digits: int | None = None) -> DataFrame:
    """F9-F16 numeric from a curve state: per model AUC, AP, CV mean / population sd, threshold, class-1 precision / recall / F1, accuracy.

    One scan of the state.  ``tune_on='test'`` picks the threshold on the test
    rows, as the analysed pipeline does; ``'validation'`` picks it on the
    pooled fold scores (and reads the state three times).
    """
    each = EV.summary(EV.curve_of(state, "score", ["model", "fold"]), "score", ["model", "fold"])
    is_test = F.col("fold") == TEST
    mean, sd = F.avg(F.when(~is_test, F.col("roc_auc"))), F.stddev_pop(F.when(~is_test, F.col("roc_auc")))
    ap = F.col("__t.average_precision")
    if digits is not None:
        mean, sd, ap = fixed(mean, digits), fixed(sd, digits), fixed(ap, digits)
    one = each.groupBy("model").agg(mean.alias("cv_auc_mean"), sd.alias("cv_auc_sd"), F.max(F.when(is_test, F.struct(
        "roc_auc", "average_precision", "threshold", "tn", "fp", "fn", "tp"))).alias("__t"))
    point = {c: F.col(f"__t.{c}") for c in ("threshold", "tn", "fp", "fn", "tp")}
    if tune_on == "validation":
        pooled = EV.merge_counts(state.where(~is_test).drop("fold"), by=["model"])
        best = EV.best_f1_threshold(EV.curve_of(pooled, "score", ["model"]), "score", ["model"]).select("model", "threshold")
        one = one.join(best.join(EV.confusion_of(state.where(is_test), best, "score", ["model"]), "model"), "model")
        point = {c: F.col(c) for c in point}
    elif tune_on != "test":
        raise ValueError(f"unknown rows to tune on: {tune_on!r}")
    position = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    return one.select("model", F.col("__t.roc_auc").alias("roc_auc"), ap.alias("average_precision"), "cv_auc_mean", "cv_auc_sd",
                      *(c.alias(n) for n, c in point.items())) \
        .select("model", "roc_auc", "average_precision", "cv_auc_mean", "cv_auc_sd", "threshold",
                *(e.alias(n) for n, e in EV.positive_scores().items()), F.try_element_at(position, F.col("model")).alias("position"))


def metrics_table(test_scores: DataFrame, fold_scores: DataFrame, order: list[str], tune_on: str = "test",
                  digits: int | None = None) -> DataFrame:
    """:func:`state_metrics` of scored rows."""
    return state_metrics(curve_state(test_scores, fold_scores), order, tune_on, digits)


def fold_auc(fold_scores: DataFrame) -> DataFrame:
    """F15 detail: AUC of every (model, fold)."""
    by = ["model", "fold"]
    return EV.roc_auc(EV.score_curve(fold_scores, C.OUTCOME, "score", by), by)


def model_metrics(res: TrainResult, tune_on: str = "test") -> DataFrame:
    return metrics_table(res.test_scores, res.fold_scores, TR.MODEL_ORDER, tune_on)


def comparison_table(metrics: DataFrame) -> DataFrame:
    """F16 + B21: the text table (3 decimals, threshold 2, CV 'mean ± sd')."""
    return metrics.orderBy("position").select(
        F.col("model").alias("Model"), fixed_text("roc_auc").alias("ROC-AUC"),
        mean_sd_text("cv_auc_mean", "cv_auc_sd").alias("CV-AUC (5-fold)"),
        fixed_text("precision_1").alias("Precision (Flip)"), fixed_text("recall_1").alias("Recall (Flip)"),
        fixed_text("f1_1").alias("F1 (Flip)"), fixed_text("accuracy").alias("Accuracy"),
        fixed_text("threshold", 2).alias("Threshold"))


def auc_from_text(table: DataFrame) -> DataFrame:
    """Numeric AUC parsed back from the text table (dashboard bar data)."""
    return table.select("Model", extract_number(F.col("ROC-AUC")).alias("auc"))


def best_model(metrics: DataFrame) -> DataFrame:
    """Highest AUC, first model in order on ties (one row)."""
    b = metrics.agg(F.max(F.struct(F.col("roc_auc"), (-F.col("position")).alias("neg_pos"),
                                   F.col("model"))).alias("b"))
    return b.select(F.col("b.model").alias("model"), F.col("b.roc_auc").alias("roc_auc"))


def feature_importance(res: TrainResult, top: int = C.IMPORTANCE_TOP) -> DataFrame:
    """F19 + B20: top ``top`` importances per tree model, percent and display label."""
    spark = res.data.sparkSession
    rows = []
    for name in (TR.FOREST, TR.BOOSTING):
        key = (name, None)
        if key in res.models:
            rows += [(name, f, v) for f, v in TR.importances(res.models[key], res.features)]
    return top_importances(spark.createDataFrame(rows, "model string, feature string, importance double"), top)


def top_importances(importances: DataFrame, top: int = C.IMPORTANCE_TOP) -> DataFrame:
    """F19 + B20 + E2 on (model, feature, importance): rank (name breaks ties), percent, display label."""
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), F.col("feature"))
    return (importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .withColumn("importance_pct", F.col("importance") * F.lit(100.0))
            .withColumn("label", pretty_feature(F.col("feature"))))


def best_scores(res: TrainResult, metrics: DataFrame) -> DataFrame:
    b = best_model(metrics).select("model")
    return res.test_scores.join(b, "model", "inner")


def scored_risk(res: TrainResult, metrics: DataFrame) -> DataFrame:
    """risk tiers by diagnosis code from the best model's test scores."""
    return RI.risk_by_key(best_scores(res, metrics), C.CODE, "score", C.OUTCOME)


def test_predictions(res: TrainResult, metrics: DataFrame) -> DataFrame:
    """the prediction export (code, name, age, probability, outcome)."""
    s = FE.add_diagnosis_name(best_scores(res, metrics))
    return s.select(C.CODE, C.DIAGNOSIS, C.AGE, F.col("score").alias("Predicted_Flip_Prob"),
                    F.col(C.OUTCOME).alias("Actual_Flipped"))


def cv_fold_auc(res: TrainResult) -> DataFrame:
    return fold_auc(res.fold_scores)


# One trained result per (application, input folder), shared by the
# registered model queries of one process.
_RESULTS: dict[tuple[str, str], tuple[TrainResult, DataFrame]] = {}
_LOCK = threading.Lock()


def trained(spark: SparkSession, sf_dir: str) -> tuple[TrainResult, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _RESULTS:
            res = train_and_score(split_encounters(spark, sf_dir))
            _RESULTS[key] = (res, model_metrics(res).cache())
        return _RESULTS[key]


def forget_trained(spark: SparkSession) -> int:
    """Drop the trained results of this application and their kept tables; returns how many."""
    with _LOCK:
        mine = [k for k in _RESULTS if k[0] == spark.sparkContext.applicationId]
        for key in mine:
            res, metrics = _RESULTS.pop(key)
            for df in (res.data, res.test_scores, res.fold_scores, metrics):
                df.unpersist()
    return len(mine)
