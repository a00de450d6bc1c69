"""Monitoring metrics, wide (one row) and long (one row per metric)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.operators.evaluate import METRICS


def metrics_to_long(wide: DataFrame) -> DataFrame:
    """(metric_name, metric_value) rows, all double, from a wide row."""
    doubles = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    return doubles.unpivot([], doubles.columns, "metric_name", "metric_value")


def _one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    # Both frames hold a single aggregated row.
    one = F.lit(1)
    return left.withColumn("_one", one).join(right.withColumn("_one", one), "_one").drop("_one")


def training_metrics(summary: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Long metrics of a training run: summary counts and ``eval_*``."""
    counts = summary.select(
        F.col("records_before").alias("records_before_preprocessing"),
        F.col("records_after").alias("records_after_preprocessing"),
        "duplicates_count",
        "invalid_dates_count",
    )
    metrics = evaluation.select(*[F.col(m).alias(f"eval_{m}") for m in METRICS])
    return metrics_to_long(_one_row(counts, metrics))


def batch_metrics(summary: DataFrame, scores: DataFrame) -> DataFrame:
    """Long metrics of a scoring run, one aggregation over the scores."""
    # Metric names, here and in training_metrics.
    p = F.col("probability_of_cancellation")
    scored = scores.agg(
        F.count(F.lit(1)).alias("predictions_count"),
        F.sum("is_high_risk").alias("high_risk_count"),
        F.avg("is_high_risk").alias("high_risk_share"),
        F.avg(p).alias("mean_cancellation_probability"),
        F.max(p).alias("max_cancellation_probability"),
        F.min(p).alias("min_cancellation_probability"),
        F.avg("risk_percentile").alias("avg_risk_percentile"),
    )
    counts = summary.select(
        F.col("records_before").alias("records_before_preprocessing"),
        F.col("records_after").alias("records_after_preprocessing"),
        "invalid_dates_count",
    )
    return metrics_to_long(_one_row(counts, scored))
