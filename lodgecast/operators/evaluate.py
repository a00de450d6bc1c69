"""Classification metrics in a few aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.functions.scoring import round_half_even
from lodgecast.plans.numbering import running_total

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def confusion_counts(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: tp, fp, tn, fn; class 1 is positive. Rows without a label are not counted."""
    actual, predicted = F.col(label) == 1, F.coalesce(F.col(prediction) == 1, F.lit(False))
    return predictions.agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(actual & ~predicted).alias("fn"),
    )


def roc_auc(
    predictions: DataFrame, label: str = "label", probability: str = "probability"
) -> DataFrame:
    """One row ``roc_auc``: the rank-sum statistic, tied scores sharing their mean rank.

    Null when only one class is present. Rows without a label or a score do not take part.
    Equal scores are combined before anything is sorted.
    """
    kept = predictions.select(F.col(label).alias("label"), F.col(probability).alias("score"))
    scores = (
        kept.filter(F.col("label").isNotNull() & F.col("score").isNotNull())
        .groupBy("score")
        .agg(F.count_if(F.col("label") == 1).alias("positives"), F.count(F.lit(1)).alias("rows"))
    )
    # A group's mean position is half its first plus half its last: exact in doubles.
    mean_rank = F.col("before") + (F.col("rows") + 1) / 2
    total = running_total(scores, "score", "rows", "before").agg(
        F.sum(mean_rank * F.col("positives")).alias("rank_sum"),
        F.sum("positives").cast("double").alias("p"),
        F.sum("rows").cast("double").alias("n"),
    )
    p, n = F.col("p"), F.col("n")
    return total.select(
        F.try_divide(F.col("rank_sum") - p * (p + 1) / 2, p * (n - p)).alias("roc_auc")
    )


def evaluate(
    predictions: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    probability: str = "probability",
) -> DataFrame:
    """One row of accuracy, precision, recall, f1 (class 1) and roc_auc, four decimals.

    A ratio with a zero denominator counts as 0.
    """

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    counts = confusion_counts(predictions, label, prediction).select(
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.lit(1).alias("_one"),
    )
    area = roc_auc(predictions, label, probability).withColumn("_one", F.lit(1))
    # Both sides are a single aggregated row.
    return counts.join(area, "_one").select(
        *[round_half_even(F.col(m), 4).alias(m) for m in METRICS]
    )
