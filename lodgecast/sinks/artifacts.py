"""A fitted model and its JSON report, under one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lodgecast.operators.train import MODEL_NAME, BookingModel, TrainingRun
from lodgecast.plans.storage import small_frame


def save_model(spark: SparkSession, model: BookingModel, report: dict, path: str) -> None:
    """Write ``path/model`` and ``path/report`` (one indented JSON text)."""
    model.save(f"{path}/model")
    text = json.dumps(report, ensure_ascii=False, indent=2)
    one = small_frame(spark, [(text,)], "value string")
    one.write.mode("overwrite").text(f"{path}/report")


def load_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/report", wholetext=True).first()["value"])


def load_model(spark: SparkSession, path: str) -> tuple[BookingModel, list[str], str]:
    """(model, categorical columns, model name) of a saved folder."""
    report = load_report(spark, path)
    name = report.get("best_model", {}).get("name", MODEL_NAME)
    return BookingModel.load(spark, f"{path}/model"), report.get("categorical_columns", []), name


def save_training_run(spark: SparkSession, run: TrainingRun, path: str) -> None:
    save_model(spark, run.model, run.report, path)


def save_stats(stats: DataFrame, path: str) -> None:
    """Keep the one-row filling statistics, which streaming jobs need."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
