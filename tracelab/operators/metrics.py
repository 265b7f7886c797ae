"""Detector metrics from score counts.

Scores are first counted by distinct value (a partial aggregate), then cumulated by descending score
with ``running_totals``, which spreads one run over many tasks. All metrics come from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.ordering import running_totals
from tracelab.operators.features import at_least_zero
from tracelab.session import materialize

GROUP = ["run_id", "score_name"]
THRESHOLDS = 201


def usable(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)


def drop_nan_scores(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Rows with a score, of the detectors that then still have both classes."""
    valid = scores.where(usable(F.col("score")))
    both = valid.groupBy(*group).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return valid.join(both.select(*group), group, "left_semi")


def score_counts(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Positives and rows of each distinct score."""
    return (
        scores.where(usable(F.col("score")))
        .groupBy(*group, "score")
        .agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )


def cumulated(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Score counts with ``tp`` and ``seen`` (positives and rows at this score or above), and the
    group's positives ``p``, rows ``total``, lowest and highest score ``lo`` and ``hi``."""
    counts = materialize(score_counts(scores, group))
    stats = {
        "p": (F.sum("pos"), F.sum), "total": (F.sum("n"), F.sum),
        "lo": (F.min("score"), F.min), "hi": (F.max("score"), F.max),
    }
    return running_totals(counts, group, "score", {"pos": "tp", "n": "seen"}, descending=True, stats=stats)


def curve_points(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    positives, negatives = F.col("p"), F.col("total") - F.col("p")
    fp = F.col("seen") - F.col("tp")
    return cumulated(scores, group).select(
        *group,
        F.col("score").alias("threshold"),
        "tp",
        fp.alias("fp"),
        (F.col("tp") / F.when(positives > 0, positives)).alias("tpr"),
        (fp / F.when(negatives > 0, negatives)).alias("fpr"),
        (F.col("tp") / F.col("seen")).alias("precision"),
    )


def _ranking_aggs() -> list[Column]:
    """AUC (ties count half) and average precision (a step sum, not a trapezoid)."""
    p, n = F.max("p").cast("double"), F.max("total").cast("double")
    negatives = (F.col("n") - F.col("pos")).cast("double")
    pairs = F.sum(negatives * (F.col("tp") - F.col("pos") / 2))
    both = F.when((p > 0) & (n > p), p * (n - p))
    steps = F.sum(F.col("pos") * (F.col("tp") / F.col("seen")))
    return [(pairs / both).alias("roc_auc"), (steps / F.when(p > 0, p)).alias("pr_auc")]


def ranking_metrics(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    return cumulated(scores, group).groupBy(*group).agg(*_ranking_aggs())


def feature_auc(features: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, auc) of scores that need no other metric."""
    return cumulated(features, group).groupBy(*group).agg(F.max("total").alias("n"), _ranking_aggs()[0].alias("auc"))


def _threshold(index: Column) -> Column:
    return F.when(index == THRESHOLDS - 1, F.col("hi")).otherwise(F.col("lo") + index * F.col("width"))


def threshold_sweep(ranked: DataFrame, group: list[str] = GROUP, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Best accuracy over 201 thresholds and the first threshold that reaches it.

    ``ranked`` comes from ``cumulated``. The thresholds run from the lowest to the highest score, or
    over ``bounds``. Each distinct score is put at the last threshold it passes, so the sweep is a
    grouping into 201 bins and running sums over them, not a product of rows and thresholds.
    """
    if bounds is not None:
        ranked = ranked.withColumns({"lo": F.lit(float(bounds[0])), "hi": F.lit(float(bounds[1]))})
    ranked = ranked.withColumn("width", (F.col("hi") - F.col("lo")) / (THRESHOLDS - 1))
    last = F.lit(THRESHOLDS - 1)
    place = F.floor((F.col("score") - F.col("lo")) / F.when(F.col("width") > 0, F.col("width"))).cast("int")
    binned = ranked.withColumn("g", F.greatest(F.lit(0), F.least(last, F.when(F.col("width") > 0, place).otherwise(last))))
    up = (F.col("g") < last) & (F.col("score") >= _threshold(F.col("g") + 1))
    down = F.col("score") < _threshold(F.col("g"))
    bins = (
        binned.withColumn("bin", F.when(up, F.col("g") + 1).when(down, F.col("g") - 1).otherwise(F.col("g")))
        .groupBy(*group, "p", "total", "lo", "hi", "width", "bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    )
    order = Window.partitionBy(*group).orderBy("bin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    swept = bins.withColumns(
        {
            "first_bin": zero(F.lag("bin").over(order) + 1),
            "pos_below": zero(F.sum("pos").over(before)),
            "n_below": zero(F.sum("n").over(before)),
        }
    )
    right = F.col("p") - F.col("pos_below") + (F.col("n_below") - F.col("pos_below"))
    # Thresholds above the highest score call every row negative.
    above = F.when(F.max("bin") < last, F.struct(((F.max("total") - F.max("p")) / F.max("total")).alias("acc"), (-F.max("bin") - 1).alias("neg")))
    best = F.greatest(F.max(F.struct((right / F.col("total")).alias("acc"), (-F.col("first_bin")).alias("neg"))), above)
    found = swept.groupBy(*group, "lo", "hi", "width").agg(best.alias("best"))
    return found.select(*group, F.col("best.acc").alias("best_accuracy"), _threshold(-F.col("best.neg")).alias("best_threshold"))


def detector_report(scores: DataFrame, group: list[str] = GROUP, bounds: tuple[float, float] | None = None) -> DataFrame:
    """AUC, average precision, accuracy at the median score, best accuracy, class counts, AUC error."""
    ranked = materialize(cumulated(scores, group))
    total, p = F.col("total"), F.col("p")
    # A score covers the ascending positions [total - seen, total - seen + n). The rows at or above
    # the median are those from the upper middle position on.
    middle = F.floor(total / 2)
    start = total - F.col("seen")
    at_middle = (middle >= start) & (middle < start + F.col("n"))
    right = F.col("tp") + (total - p) - (F.col("seen") - F.col("tp"))
    summary = ranked.groupBy(*group).agg(
        *_ranking_aggs(),
        F.max("total").alias("n_samples"),
        F.max("p").alias("n_halluc"),
        F.max(F.when(at_middle, right / total)).alias("accuracy"),
    )
    positives, n = F.col("n_halluc"), F.col("n_samples")
    return (
        summary.join(threshold_sweep(ranked, group, bounds), group)
        .select(
            *group, "roc_auc", "pr_auc", "accuracy", "best_accuracy", "best_threshold",
            (positives / n).alias("pos_rate"), "n_samples", "n_halluc", (n - positives).alias("n_correct"),
            auc_error(F.col("roc_auc"), positives, n - positives).alias("roc_auc_se"),
        )
    )


def auc_error(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Standard error of an AUC after Hanley and McNeil (1982); NULL without both classes."""
    pairs = F.when((n_pos > 0) & (n_neg > 0), n_pos * n_neg)
    square = auc * auc
    above = (n_pos - 1) * (auc / (2 - auc) - square)
    below = (n_neg - 1) * (2 * square / (1 + auc) - square)
    return F.sqrt(at_least_zero((auc * (1 - auc) + above + below) / pairs))


def confusion(scores: DataFrame, threshold: float = 0.5, group: list[str] = GROUP) -> DataFrame:
    """Confusion counts and accuracy at a fixed threshold."""
    hit, positive = F.col("score") >= threshold, F.col("label") == 1
    return scores.where(usable(F.col("score"))).groupBy(*group).agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & positive).alias("fn"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.avg((hit == positive).cast("double")).alias("accuracy"),
    )


def class_means(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    return scores.where(usable(F.col("score"))).groupBy(*group).agg(
        F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("mean_correct"),
        F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("mean_halluc"),
    )


def class_counts(rows: DataFrame, group: list[str]) -> DataFrame:
    """n, positives, negatives and positive rate of each group."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("n_halluc"),
        F.count_if(F.col("label") == 0).alias("n_correct"),
        F.avg(F.col("label").cast("double")).alias("pos_rate"),
    )


def judged_accuracy(judged: DataFrame) -> DataFrame:
    """Share of answers judged ``no`` per run."""
    return judged.groupBy("run_id").agg(F.avg((F.col("is_hallucination") == "no").cast("double")).alias("accuracy"))


def top_features(auc: DataFrame, k: int, group: list[str]) -> DataFrame:
    """The k features with the highest max(AUC, 1 - AUC); a single class counts 0.5.

    ``auc`` has one row per feature, so the window is as small as the feature list.
    """
    strength = F.coalesce(F.greatest("auc", 1 - F.col("auc")), F.lit(0.5))
    order = Window.partitionBy(*group).orderBy(F.desc("strength"), "feature")
    return auc.withColumn("strength", strength).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
