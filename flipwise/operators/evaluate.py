"""Binary-classifier evaluation from one grouped-score table.

Every curve and metric derives from ``score_curve``: one row per distinct
score (per ``by`` group, e.g. per model) with the positives and negatives at
that score and the cumulative counts from the top (predict positive when
score >= threshold).  Rows are first collapsed to distinct scores
(``score_counts``, partial aggregation), a table that can be stored, merged
with that of new rows and read for every metric.  The cumulative sums of a
large group use the two-level scheme of ``rank.two_level_rank``: running
totals per score bucket over a small table, then windows inside each bucket
only.  No step moves an unbounded number of scores to one task.

Rules (the ones of the common Python reference implementation):

* PR curve: one point per distinct score plus a final (precision 1, recall 0);
* F1-optimal threshold: max of 2PR / (P + R + 1e-9), lowest score on ties;
* ROC-AUC: probability that a positive outranks a negative, ties count 1/2;
* average precision: step rule, sum of (R_n - R_n-1) * P_n;
* ROC curve: starts at (0, 0) and drops interior points whose neighbours
  have the same increments (collinear), unless ``drop_intermediate=False``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exact_sum import exact_sums
from ..functions.numeric import fixed, ratio
from .distribution import with_stats
from .quantile import STATE_VALUES, group_cuts, largest_group, with_bucket

N_BUCKETS = 4096


def score_counts(df: DataFrame, label: str = C.OUTCOME, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by.., score, pos, neg) per distinct score: additive, so tables of it merge by summing.  Rows with a NULL label or score are ignored."""
    y = F.col(label)
    return (df.where(y.isNotNull() & F.col(score).isNotNull()).groupBy(*(by or []), score)
            .agg(F.sum(y).cast("bigint").alias("pos"), F.count(y).alias("__n"))
            .withColumn("neg", F.col("__n") - F.col("pos")).drop("__n"))


def merge_counts(*counts: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Sum of several ``score_counts`` tables."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy(*(by or []), score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def score_curve(df: DataFrame, label: str = C.OUTCOME, score: str = "score",
                by: list[str] | None = None, n_buckets: int = N_BUCKETS, state_rows: int = STATE_VALUES) -> DataFrame:
    """The curve of the rows' distinct scores, see :func:`curve_of`."""
    return curve_of(score_counts(df, label, score, by), score, by, n_buckets, state_rows)


def curve_of(g: DataFrame, score: str = "score", by: list[str] | None = None, n_buckets: int = N_BUCKETS,
             state_rows: int = STATE_VALUES) -> DataFrame:
    """One row per (by, distinct score) of a ``score_counts`` table: pos, neg, tp, fp, P, N, is_first, next_pos, next_neg.

    The largest group is counted first.  Groups of up to ``state_rows`` scores
    take one window each; beyond, each group is cut into buckets by a sketch of
    its own scores, so any range or crowding of scores spreads evenly.  The
    result is exact either way.
    """
    by = list(by or [])
    if largest_group(g, by) <= state_rows:
        down = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(score).desc())
        upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return g.select(*by, score, "pos", "neg", F.sum("pos").over(upto).alias("tp"), F.sum("neg").over(upto).alias("fp"),
                        F.sum("pos").over(every).alias("P"), F.sum("neg").over(every).alias("N"), (F.row_number().over(down) == 1).alias("is_first"),
                        F.lead("pos").over(down).alias("next_pos"), F.lead("neg").over(down).alias("next_neg"))
    g = with_bucket(g, group_cuts(g, score, by, n_buckets), score, by, n_buckets)
    # Small table: one row per (by, bucket).
    bt = g.groupBy(*by, "__b").agg(
        F.sum("pos").alias("__bpos"), F.sum("neg").alias("__bneg"),
        F.max_by(F.struct("pos", "neg"), F.col(score)).alias("__first"))
    above = Window.partitionBy(*by).orderBy(F.col("__b").desc())
    above_rows = above.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offs = bt.select(
        *by, "__b",
        F.coalesce(F.sum("__bpos").over(above_rows), F.lit(0)).alias("__opos"),
        F.coalesce(F.sum("__bneg").over(above_rows), F.lit(0)).alias("__oneg"),
        F.lead(F.col("__first")).over(above).alias("__nextfirst"),
        F.sum("__bpos").over(all_rows).alias("P"),
        F.sum("__bneg").over(all_rows).alias("N"),
        (F.row_number().over(above) == 1).alias("__topbucket"))
    inner = Window.partitionBy(*by, "__b").orderBy(F.col(score).desc())
    running = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = g.join(offs, [*by, "__b"], "inner")
    return j.select(
        *by, score, "pos", "neg",
        (F.col("__opos") + F.sum("pos").over(running)).alias("tp"),
        (F.col("__oneg") + F.sum("neg").over(running)).alias("fp"),
        "P", "N",
        (F.col("__topbucket") & (F.row_number().over(inner) == 1)).alias("is_first"),
        F.coalesce(F.lead("pos").over(inner), F.col("__nextfirst.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inner), F.col("__nextfirst.neg")).alias("next_neg"))


def pr_curve(curve: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """F8: (threshold, precision, recall); the final point has a NULL threshold.

    The final point is emitted by the top-score row of each group in the same
    pass (an ``explode``), so the curve is computed once.
    """
    by = list(by or [])
    recall = F.when(F.col("P") > 0, ratio("tp", "P")).otherwise(F.lit(1.0))
    pt = F.struct(F.col(score).cast("double").alias("threshold"),
                  ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), recall.alias("recall"))
    fin = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                   F.lit(0.0).alias("recall"))
    pts = F.when(F.col("is_first"), F.array(pt, fin)).otherwise(F.array(pt))
    return curve.select(*by, F.inline(pts))


def _f1(p, r):
    return F.lit(2.0) * p * r / (p + r + F.lit(C.F1_EPS))


def best_f1_threshold(curve: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """the threshold of maximal F1 (lowest score among equal F1), one row per group."""
    by = list(by or [])
    pr = pr_curve(curve, score, by).where(F.col("threshold").isNotNull())
    best = F.max(F.struct(_f1(F.col("precision"), F.col("recall")).alias("f1"),
                          (-F.col("threshold")).alias("neg_t"),
                          F.col("precision"), F.col("recall")))
    g = pr.groupBy(*by) if by else pr.groupBy()
    return g.agg(best.alias("__b")).select(
        *by, (-F.col("__b.neg_t")).alias("threshold"), F.col("__b.precision").alias("precision"),
        F.col("__b.recall").alias("recall"), F.col("__b.f1").alias("f1"))


def roc_auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rank-sum AUC with ties counted 1/2, exact integer sums.

    AUC = (2 * sum(pos * negatives below) + sum(pos * neg)) / (2 * P * N); the
    sums are DECIMAL(38, 0), so they cannot overflow at any realistic size.
    NULL when a class is absent.
    """
    by = list(by or [])
    d = "decimal(38,0)"
    below = (F.col("N") - F.col("fp")).cast(d)
    g = curve.groupBy(*by) if by else curve.groupBy()
    return g.agg(
        F.sum(F.col("pos").cast(d) * below).alias("__a"),
        F.sum(F.col("pos").cast(d) * F.col("neg").cast(d)).alias("__t"),
        F.max("P").alias("P"), F.max("N").alias("N")).select(
        *by, ratio(F.lit(2).cast(d) * F.col("__a") + F.col("__t"),
                   F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")).alias("roc_auc"))


def average_precision(curve: DataFrame, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """step-rule average precision, sum(pos * precision) / P; rounded only if ``digits`` is given."""
    by = list(by or [])
    g = curve.groupBy(*by) if by else curve.groupBy()
    ap = ratio(F.col("__s"), F.col("P"))
    return g.agg(F.sum(F.col("pos") * ratio("tp", F.col("tp") + F.col("fp"))).alias("__s"),
                 F.max("P").alias("P")).select(
        *by, (fixed(ap, digits) if digits is not None else ap).alias("average_precision"))


def average_precision_exact(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F12 without rounding: the terms add up exactly, so the bits do not depend on the partitioning."""
    by = list(by or [])
    total = exact_sums(curve, {"__s": F.col("pos") * ratio("tp", F.col("tp") + F.col("fp")), "__p": F.col("pos")}, by)
    return total.select(*by, ratio("__s", "__p").alias("average_precision"))


def _simplified(pts: DataFrame, x: str, y: str, bound, by: list[str]) -> DataFrame:
    """First and last point of each (by, __cell) of points that lie in order of ``__n`` (a cell is a run of them).

    ``error`` is the greatest vertical distance, over the points left out of the
    cell, from the chord that replaces them; ``error_bound`` is ``bound`` of the
    cell.  The table of cells is small; the points meet it in a join.
    """
    at = lambda f: f(F.struct(x, y, "threshold", "tp", "fp"), F.col("__n"))
    cells = pts.groupBy(*by, "__cell").agg(at(F.min_by).alias("__f"), at(F.max_by).alias("__l"), F.max("P").alias("P"), F.max("N").alias("N"))
    f, l = F.col("__f"), F.col("__l")  # noqa: E741
    run = l[x] - f[x]
    chord = F.when(run != 0, f[y] + (l[y] - f[y]) * ((F.col(x) - f[x]) / F.nullif(run, F.lit(0.0)))).otherwise(F.col(y))
    joined = pts.select(*by, "__cell", x, y).join(cells, [*by, "__cell"], "inner")
    worst = joined.groupBy(*by, "__cell").agg(F.max(F.abs(F.col(y) - chord)).alias("error"), F.first("__f").alias("__f"), F.first("__l").alias("__l"),
                                              F.first("P").alias("P"), F.first("N").alias("N"))
    ends = F.when(f["threshold"].eqNullSafe(l["threshold"]), F.array(f)).otherwise(F.array(f, l))
    return worst.withColumn("error_bound", bound(f, l)).select(*by, F.inline(F.transform(ends, lambda p: F.struct(
        p[x].alias(x), p[y].alias(y), p["threshold"].alias("threshold"), F.col("error").alias("error"), F.col("error_bound").alias("error_bound")))))


def roc_curve_bounded(curve: DataFrame, max_points: int = 512, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """F17 in at most ``max_points`` points a group: fpr, tpr, threshold, error, error_bound; :func:`roc_curve` stays exact.

    Both rates only rise, so fpr + tpr orders the points; it is cut into equal
    cells and each keeps its first and last point.  Between them tpr rises by at
    most ``error_bound``, so no point left out is farther from the chord.
    Groups without positives or without negatives have no points.
    """
    by = list(by or [])
    n_cells = _cells(max_points)
    pts = (curve.where((F.col("P") > 0) & (F.col("N") > 0))
           .withColumn("fpr", ratio("fp", "N")).withColumn("tpr", ratio("tp", "P")).withColumn("threshold", F.col(score).cast("double"))
           .withColumn("__n", F.col("tp") + F.col("fp"))
           .withColumn("__cell", F.least(F.floor((F.col("fpr") + F.col("tpr")) * F.lit(n_cells / 2)), F.lit(n_cells - 1)))
           .select(*by, "__cell", "__n", "fpr", "tpr", "threshold", "tp", "fp", "P", "N"))
    kept = _simplified(pts, "fpr", "tpr", lambda f, l: l["tpr"] - f["tpr"], by)
    start = curve.where(F.col("is_first") & (F.col("P") > 0) & (F.col("N") > 0)).select(
        *by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("error"), F.lit(0.0).alias("error_bound"))
    return kept.unionByName(start)


def pr_curve_bounded(curve: DataFrame, max_points: int = 1024, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """F8 in at most ``max_points`` points a group: recall, precision, threshold, error, error_bound; :func:`pr_curve` stays exact.

    Cells are by the number predicted positive, n = tp + fp: its leading bits,
    as many as ``max_points`` allows, so a cell spans a fixed share of n and the
    few points of small n all stay.  Within a cell precision lies between
    tp_first / (tp_first + fp_last) and tp_last / (tp_last + fp_first);
    ``error_bound`` is the greatest distance of those from either end of the
    chord.  Groups without positives have no points.
    """
    by = list(by or [])
    _cells(max_points)
    n, bits = F.col("__n"), F.length(F.bin(F.col("P") + F.col("N")))
    # 2^lead cells for each length of n, two points a cell and the final point; bits of n are few, so integers decide
    lead = F.lit(-1)
    for b in range(0, 21):
        lead = F.when(bits.cast("bigint") * F.lit(2 ** (b + 1)) + 1 <= F.lit(max_points), F.lit(b)).otherwise(lead)
    drop = F.greatest(F.length(F.bin(n)) - 1 - F.col("__lead"), F.lit(0))
    pts = (curve.where(F.col("P") > 0).withColumn("recall", ratio("tp", "P")).withColumn("__n", F.col("tp") + F.col("fp"))
           .withColumn("precision", ratio("tp", "__n")).withColumn("threshold", F.col(score).cast("double")).withColumn("__lead", lead)
           # lead < 0: even one cell a length is too many, so all of a group's points but the ends go
           .withColumn("__cell", F.when(F.col("__lead") < 0, F.lit(0).cast("bigint"))
                       .otherwise(drop.cast("bigint") * F.lit(2 ** 32) + F.call_function("shiftright", n, drop)))
           .select(*by, "__cell", "__n", "recall", "precision", "threshold", "tp", "fp", "P", "N"))

    def bound(f, l):  # noqa: E741
        high, low = ratio(l["tp"], l["tp"] + f["fp"]), F.coalesce(ratio(f["tp"], f["tp"] + l["fp"]), F.lit(0.0))
        one = f["threshold"] == l["threshold"]
        return F.when(one, F.lit(0.0)).otherwise(F.greatest(high - F.least(f["precision"], l["precision"]), F.greatest(f["precision"], l["precision"]) - low))
    kept = _simplified(pts, "recall", "precision", bound, by)
    final = curve.where(F.col("is_first") & (F.col("P") > 0)).select(
        *by, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("error"), F.lit(0.0).alias("error_bound"))
    return kept.unionByName(final)


def _cells(max_points: int) -> int:
    """Cells of two points each beside the point that every curve ends with."""
    if max_points < 4:
        raise ValueError("a curve needs at least 4 points")
    return (max_points - 1) // 2


def roc_curve(curve: DataFrame, score: str = "score", by: list[str] | None = None,
              drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) points, starting at (0, 0) with a NULL threshold.

    The start point is emitted by the top-score row (always kept) in the same
    pass, so the curve is computed once.
    """
    by = list(by or [])
    pts = curve
    if drop_intermediate:
        keep = (F.col("is_first") | F.col("next_pos").isNull()
                | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
        pts = pts.where(keep)
    pt = F.struct(ratio("fp", "N").alias("fpr"), ratio("tp", "P").alias("tpr"),
                  F.col(score).cast("double").alias("threshold"))
    start = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                     F.lit(None).cast("double").alias("threshold"))
    return pts.select(*by, F.inline(F.when(F.col("is_first"), F.array(start, pt)).otherwise(F.array(pt))))


def confusion_counts(df: DataFrame, thresholds: DataFrame, label: str = C.OUTCOME,
                     score: str = "score", by: list[str] | None = None) -> DataFrame:
    """F10 + F13 as one row per group: tn, fp, fn, tp at ``score >= threshold``.

    ``thresholds`` has one row per group (``by`` columns + ``threshold``).
    Rows meet it on (group, salt of the score), not on a handful of groups.
    """
    by = list(by or [])
    j = with_stats(df.select(*by, label, score), thresholds.select(*by, "threshold"), by, score)
    y = F.col(label)
    pred = F.col(score) >= F.col("threshold")
    g = j.groupBy(*by) if by else j.groupBy()
    return g.agg(F.count_if((y == 0) & ~pred).alias("tn"), F.count_if((y == 0) & pred).alias("fp"),
                 F.count_if((y == 1) & ~pred).alias("fn"), F.count_if((y == 1) & pred).alias("tp"))


def confusion_of(g: DataFrame, thresholds: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """:func:`confusion_counts` from a ``score_counts`` table."""
    by = list(by or [])
    j = with_stats(g, thresholds.select(*by, "threshold"), by, score)
    above = F.col(score) >= F.col("threshold")
    total = lambda c, inside: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0))
    return (j.groupBy(*by) if by else j.groupBy()).agg(total("neg", ~above).alias("tn"), total("neg", above).alias("fp"),
                                                       total("pos", ~above).alias("fn"), total("pos", above).alias("tp"))


def summary(curve: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """F9, F11, F12 and F13 of a curve in one aggregate: roc_auc, average_precision, threshold (maximal F1, lowest on ties), tn, fp, fn, tp at it."""
    by = list(by or [])
    d = "decimal(38,0)"
    precision, recall = ratio("tp", F.col("tp") + F.col("fp")), F.when(F.col("P") > 0, ratio("tp", "P")).otherwise(F.lit(1.0))
    best = F.max(F.struct(_f1(precision, recall).alias("f1"), (-F.col(score)).alias("neg_t"), F.col("tp"), F.col("fp")))
    g = curve.groupBy(*by) if by else curve.groupBy()
    one = g.agg(F.sum(F.col("pos").cast(d) * (F.col("N") - F.col("fp")).cast(d)).alias("__a"),
                F.sum(F.col("pos").cast(d) * F.col("neg").cast(d)).alias("__t"), F.max("P").alias("__p"), F.max("N").alias("__n"),
                F.sum(F.col("pos") * precision).alias("__s"), best.alias("__b"))
    return one.select(
        *by, ratio(F.lit(2).cast(d) * F.col("__a") + F.col("__t"), F.lit(2.0) * F.col("__p").cast("double") * F.col("__n").cast("double")).alias("roc_auc"),
        ratio("__s", "__p").alias("average_precision"), (-F.col("__b.neg_t")).alias("threshold"),
        (F.col("__n") - F.col("__b.fp")).alias("tn"), F.col("__b.fp").alias("fp"), (F.col("__p") - F.col("__b.tp")).alias("fn"), F.col("__b.tp").alias("tp"))


def positive_scores() -> dict:
    """F14, the part of the comparison table, as expressions over tn, fp, fn, tp: precision, recall and F1 of class 1, accuracy; 0/0 is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"precision_1": z(tp, tp + fp), "recall_1": z(tp, tp + fn), "f1_1": z(F.lit(2.0) * tp, F.lit(2.0) * tp + fn + fp),
            "accuracy": z(tp + tn, tn + fp + fn + tp)}


def confusion_matrix(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """long 2 x 2 table (actual, predicted, n), zero cells included."""
    by = list(by or [])
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
                      for a, p, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return counts.select(*by, F.inline(cells))


def classification_report(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """per class precision / recall / F1 / support, accuracy, macro and
    weighted averages.  A 0/0 ratio is reported as 0."""
    by = list(by or [])
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    z = lambda e: F.coalesce(e, F.lit(0.0))
    p1, r1 = z(F.try_divide(tp, tp + fp)), z(F.try_divide(tp, tp + fn))
    p0, r0 = z(F.try_divide(tn, tn + fn)), z(F.try_divide(tn, tn + fp))
    f1_1 = z(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fn + fp))
    f1_0 = z(F.try_divide(F.lit(2.0) * tn, F.lit(2.0) * tn + fn + fp))
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    acc = z(F.try_divide(tp + tn, n))

    def w(a, b):
        return z(F.try_divide(a * s0 + b * s1, n))

    rows = [
        ("0", p0, r0, f1_0, s0), ("1", p1, r1, f1_1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        ("macro avg", (p0 + p1) / F.lit(2.0), (r0 + r1) / F.lit(2.0), (f1_0 + f1_1) / F.lit(2.0), n),
        ("weighted avg", w(p0, p1), w(r0, r1), w(f1_0, f1_1), n),
    ]
    arr = F.array(*[F.struct(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"),
                             f.alias("f1_score"), s.cast("bigint").alias("support"))
                    for k, p, r, f, s in rows])
    return counts.select(*by, F.inline(arr))
