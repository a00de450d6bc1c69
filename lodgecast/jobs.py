"""Whole jobs: training and batch scoring with everything they leave behind.

The sinks cannot be written in one transaction. Each of them replaces what the same run wrote
before, and the run is listed as finished last (see ``sinks.tables``), so a job that failed half way
shows nothing to :func:`~lodgecast.sinks.tables.finished` and is run again with the same ``run_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodgecast.operators.clean import imputation_stats
from lodgecast.operators.monitor import batch_metrics, training_metrics
from lodgecast.operators.train import (
    FULL_PARAMS,
    MODEL_NAME,
    ScoringRun,
    TrainingRun,
    score_batch,
    train_and_report,
)
from lodgecast.plans.storage import stored
from lodgecast.schemas import RISK_SHARE
from lodgecast.sinks.artifacts import load_model, load_stats, save_stats, save_training_run
from lodgecast.sinks.files import write_high_risk, write_scores
from lodgecast.sinks.tables import (
    append_model_run,
    append_monitoring,
    append_predictions,
    finish_run,
    open_run,
)


def run_training(
    bookings: DataFrame, model_path: str, database: str, run_id: str, params: dict | None = None
) -> TrainingRun:
    """Train on labelled bookings; keep model, report and filling statistics below
    ``model_path``, and the run's row and metrics in the tables of ``database``.

    ``bookings`` is written once. The statistics are those of the training rows, for streams and
    for batches that should be filled like the training data.
    """
    spark = bookings.sparkSession
    params = FULL_PARAMS if params is None else params
    open_run(spark, database, "train", MODEL_NAME, run_id)
    raw = stored(bookings, "training-input")
    stats = stored(imputation_stats(raw), "statistics")
    run = train_and_report(raw, params, stats=stats)
    save_training_run(spark, run, model_path)
    save_stats(stats, f"{model_path}/statistics")
    append_model_run(run.metrics, params, f"{database}.model_runs", MODEL_NAME, run.version, run_id)
    metrics = training_metrics(run.summary, run.metrics)
    append_monitoring(metrics, f"{database}.monitoring_metrics", "train", MODEL_NAME, run_id)
    finish_run(spark, database, "train", MODEL_NAME, run_id)
    return run


def run_batch(
    bookings: DataFrame,
    model_path: str,
    output: str,
    database: str,
    run_id: str,
    share: float = RISK_SHARE,
    fmt: str = "parquet",
    training_stats: bool = False,
) -> ScoringRun:
    """Score new bookings with a saved model: ``output/scores``, ``output/high_risk``, prediction
    rows and metrics. Gaps are filled from the batch itself, or with ``training_stats`` from the
    statistics kept beside the model.
    """
    spark = bookings.sparkSession
    model, _, name = load_model(spark, model_path)
    open_run(spark, database, "batch_predict", name, run_id)
    stats = load_stats(spark, f"{model_path}/statistics") if training_stats else None
    result = score_batch(stored(bookings, "batch-input"), model, share, stats)
    scores = stored(result.scores, "scores")
    write_scores(scores, f"{output}/scores", fmt)
    write_high_risk(scores, f"{output}/high_risk", fmt)
    append_predictions(scores, f"{database}.predictions", name, run_id)
    metrics = batch_metrics(result.cleaned.counts, scores)
    append_monitoring(metrics, f"{database}.monitoring_metrics", "batch_predict", name, run_id)
    finish_run(spark, database, "batch_predict", name, run_id)
    return ScoringRun(scores, result.cleaned)


def stream_statistics(spark: SparkSession, model_path: str) -> DataFrame:
    """The filling statistics that a stream of single requests needs."""
    return load_stats(spark, f"{model_path}/statistics")
