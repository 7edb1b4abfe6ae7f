"""Confusion counts, ROC points and the metrics derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.operators.ordering import running_sums


def _ratio(a, b) -> Column:
    """a / b as a number, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(df: DataFrame, observed: str, predicted: str, positive="driver", by=()) -> DataFrame:
    """tp, fp, fn, tn in one row per `by` group."""
    obs, pred = F.col(observed) == F.lit(positive), F.col(predicted) == F.lit(positive)
    return df.groupBy(*by).agg(
        F.count_if(obs & pred).alias("tp"), F.count_if(~obs & pred).alias("fp"),
        F.count_if(obs & ~pred).alias("fn"), F.count_if(~obs & ~pred).alias("tn"),
    )


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Agreement metrics of a confusion table."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    positives, negatives = tp + fn, fp + tn
    sensitivity, specificity = _ratio(tp, positives), _ratio(tn, negatives)
    accuracy, precision = _ratio(tp + tn, n), _ratio(tp, tp + fp)

    def share(a, b):
        return _ratio(a, n) * _ratio(b, n)

    expected = share(positives, tp + fp) + share(negatives, fn + tn)
    gap = F.abs(fp - fn).cast("double")
    corrected = F.when(gap == 0, gap).otherwise(gap - 1)
    return counts.select(
        "*",
        accuracy.alias("accuracy"),
        _ratio(accuracy - expected, 1 - expected).alias("kappa"),
        _ratio(F.greatest(positives, negatives), n).alias("no_information_rate"),
        sensitivity.alias("sensitivity"), specificity.alias("specificity"),
        precision.alias("ppv"), _ratio(tn, tn + fn).alias("npv"),
        precision.alias("precision"), sensitivity.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(positives, n).alias("prevalence"), _ratio(tp, n).alias("detection_rate"),
        _ratio(tp + fp, n).alias("detection_prevalence"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
        _ratio(corrected * corrected, fp + fn).alias("mcnemar_chi2"),
    )


def roc_points(df: DataFrame, observed: str, score: str, positive="driver", by=()) -> DataFrame:
    """One point per distinct score: everything at or above it is called positive.

    Rows are counted per score first, so ties form one point.
    """
    hit = F.col(observed) == F.lit(positive)
    per_score = (
        df.select(*by, F.col(score).cast("double").alias("threshold"), hit.alias("_hit"))
        .groupBy(*by, "threshold")
        .agg(F.count_if(F.col("_hit")).alias("n_pos"), F.count_if(~F.col("_hit")).alias("n_neg"))
    )
    return running_sums(per_score, "threshold", {"tp": "n_pos", "fp": "n_neg"}, by)


def roc_curve(points: DataFrame, by=()) -> DataFrame:
    return points.select(
        *by, "threshold", "tp", "fp",
        _ratio(F.col("tp"), F.col("total_tp")).alias("tpr"),
        _ratio(F.col("fp"), F.col("total_fp")).alias("fpr"),
    )


def auc_value() -> Column:
    """Area under the ROC points, ties counting half."""
    area = (
        F.col("n_neg").cast("double") * (F.col("tp") - F.col("n_pos")).cast("double")
        + F.col("n_neg").cast("double") * F.col("n_pos").cast("double") / 2
    )
    return _ratio(F.sum(area), F.sum("n_pos").cast("double") * F.sum("n_neg").cast("double"))


def auc(df: DataFrame, observed: str, score: str, positive="driver", by=()) -> DataFrame:
    return roc_points(df, observed, score, positive, by).groupBy(*by).agg(auc_value().alias("auc"))


def threshold_metrics(df: DataFrame, observed: str, score: str, positive="driver",
                      threshold: float = 0.5, by=()) -> DataFrame:
    """Summary of an external score: area, separation, and the rates at a threshold."""
    points = roc_points(df, observed, score, positive, by)
    p, n = F.col("total_tp"), F.col("total_fp")
    tpr, fpr = _ratio(F.col("tp"), p), _ratio(F.col("fp"), n)
    at = F.col("threshold") >= F.lit(threshold)
    errors = _ratio(F.col("fp") + p - F.col("tp"), p + n)
    summary = points.groupBy(*by).agg(
        auc_value().alias("auc"),
        F.greatest(F.max(tpr - fpr), F.lit(0.0)).alias("ks"),
        F.least(F.min(errors), _ratio(F.max(p), F.max(p + n))).alias("min_error_rate"),
        F.coalesce(F.max(F.when(fpr <= 0.05, tpr)), F.lit(0.0)).alias("sens_at_95_spec"),
        F.coalesce(F.max(F.when(tpr >= 0.95, 1 - fpr)), F.lit(0.0)).alias("spec_at_95_sens"),
        F.coalesce(F.sum(F.when(at, F.col("n_pos"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(at, F.col("n_neg"))), F.lit(0)).alias("_fp"),
        F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"),
    )
    tp, fp, p, n = (F.col(c) for c in ("_tp", "_fp", "_p", "_n"))
    return summary.select(
        *by, "auc", (2 * F.col("auc") - 1).alias("gini"), "ks", "min_error_rate",
        "sens_at_95_spec", "spec_at_95_sens",
        _ratio(fp + p - tp, p + n).alias("error_rate"),
        _ratio(tp, p).alias("tpr"), _ratio(fp, n).alias("fpr"),
        _ratio(2 * tp, tp + fp + p).alias("f1"),
        (_ratio(tp, p) - _ratio(fp, n)).alias("youden"),
    )


def fold_summary(df: DataFrame, observed: str, predicted: str, score: str, positive="driver",
                 fold: str = "fold") -> DataFrame:
    """ROC area, sensitivity and specificity per fold."""
    rates = confusion_metrics(confusion(df, observed, predicted, positive, [fold]))
    areas = auc(df, observed, score, positive, [fold])
    return areas.join(rates.select(fold, "sensitivity", "specificity"), fold).select(
        fold, F.col("auc").alias("roc"), F.col("sensitivity").alias("sens"),
        F.col("specificity").alias("spec"),
    )


def mean_over_folds(summary: DataFrame) -> DataFrame:
    return summary.agg(*[F.avg(c).alias(c) for c in ("roc", "sens", "spec")])


COMPARED = ("accuracy", "precision", "recall", "f1")


def comparison(predictions: DataFrame, observed: str, predicted: str, score: str,
               positive="driver", classifier: str = "classifier") -> DataFrame:
    """Long table (classifier, measure, score) over predictions tagged by classifier."""
    rates = confusion_metrics(confusion(predictions, observed, predicted, positive, [classifier]))
    areas = auc(predictions, observed, score, positive, [classifier])
    wide = rates.select(classifier, *COMPARED).join(areas, classifier)
    return wide.unpivot([classifier], [*COMPARED, "auc"], "measure", "score")


def predictions_long(df: DataFrame, observed: str, scores: dict[str, str], threshold: float = 0.5,
                     positive="driver", negative="passenger") -> DataFrame:
    """Several score columns of the same rows, stacked and cut at a threshold."""
    frames = [
        df.select(
            F.lit(name).alias("classifier"), F.col(observed).alias("obs"),
            F.col(c).cast("double").alias("score"),
            F.when(F.col(c) >= threshold, F.lit(positive)).otherwise(F.lit(negative)).alias("pred"),
        )
        for name, c in scores.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)
