"""The run tables. Each is partitioned by what identifies a write, and writing the same run, type
and model again replaces only that.

Several tables cannot be written in one transaction. A job therefore takes its run off the list of
finished runs, writes its tables and puts the run on the list last; :func:`finished` reads only what
is listed. A job that failed half way shows nothing, and is simply run again with the same
``run_id``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Table layouts.
TABLES = {
    "model_runs": (
        "model_version string, accuracy double, f1 double, roc_auc double, "
        "parameters_json string, created_at timestamp, run_id string, model_name string"
    ),
    "predictions": (
        "booking_id string, probability_of_cancellation double, rank bigint, "
        "risk_percentile double, is_high_risk boolean, risk_segment string, "
        "created_at timestamp, run_id string, model_name string"
    ),
    "monitoring_metrics": (
        "metric_name string, metric_value double, "
        "created_at timestamp, run_id string, model_name string, run_type string"
    ),
    "finished_runs": (
        "rows_json string, created_at timestamp, run_id string, model_name string, run_type string"
    ),
}
# The type of the runs that write a table; ``monitoring_metrics`` has it in a column.
RUN_TYPES = {"model_runs": "train", "predictions": "batch_predict"}
# What identifies a write, and so the partitions it replaces.
KEYS = {
    "model_runs": ["run_id", "model_name"],
    "predictions": ["run_id", "model_name"],
    "monitoring_metrics": ["run_id", "model_name", "run_type"],
    "finished_runs": ["run_id", "model_name", "run_type"],
}


def ensure_run_tables(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create the database and its run tables where missing."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    for name, columns in TABLES.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) "
            f"USING parquet PARTITIONED BY ({', '.join(KEYS[name])})"
        )


def _place(keys: dict[str, str]) -> str:
    for name, value in keys.items():
        if not re.fullmatch(r"[A-Za-z0-9_.: -]+", value):
            raise ValueError(f"{name} {value!r} may hold letters, digits, blanks and _ . : - only")
    return ", ".join(f"{name} = '{value}'" for name, value in keys.items())


def _replace(df: DataFrame, table: str, keys: dict[str, str], created_at: Column | None) -> None:
    place = _place(keys)
    spark = df.sparkSession
    stamp = F.current_timestamp() if created_at is None else created_at
    columns = [c for c in spark.table(table).columns if c not in keys]
    rows = df.withColumn("created_at", stamp).select(*columns)
    # Fixed partition values limit the overwrite to this write's own rows.
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({place}) SELECT * FROM {{rows}}", rows=rows)


def open_run(spark: SparkSession, database: str, run_type: str, model_name: str, run_id: str) -> None:
    """Hide a run, new or finished before, until :func:`finish_run`; call it before the first write."""
    place = _place({"run_id": run_id, "model_name": model_name, "run_type": run_type})
    spark.sql(f"ALTER TABLE {database}.finished_runs DROP IF EXISTS PARTITION ({place})")


def finish_run(
    spark: SparkSession, database: str, run_type: str, model_name: str, run_id: str, created_at: Column | None = None
) -> None:
    """List a run as finished, with the rows it has in each table; call it after the last write."""
    rows = {}
    for table, kind in {**RUN_TYPES, "monitoring_metrics": run_type}.items():
        if kind == run_type:
            own = spark.table(f"{database}.{table}").filter((F.col("run_id") == run_id) & (F.col("model_name") == model_name))
            rows[table] = (own.filter(F.col("run_type") == run_type) if table not in RUN_TYPES else own).count()
    listed = spark.range(1).select(F.lit(json.dumps(rows, sort_keys=True)).alias("rows_json"))
    keys = {"run_id": run_id, "model_name": model_name, "run_type": run_type}
    _replace(listed, f"{database}.finished_runs", keys, created_at)


def finished(spark: SparkSession, database: str, table: str) -> DataFrame:
    """The rows of one of the run tables that belong to finished runs.

    All names are partition columns, so files of other runs are not read.
    """
    runs = spark.table(f"{database}.finished_runs").select("run_id", "model_name", "run_type")
    if table in RUN_TYPES:
        runs = runs.filter(F.col("run_type") == RUN_TYPES[table]).drop("run_type")
    return spark.table(f"{database}.{table}").join(runs, runs.columns, "left_semi")


def append_predictions(
    scores: DataFrame,
    table: str,
    model_name: str,
    run_id: str,
    created_at: Column | None = None,
) -> None:
    """Score rows of one run and model; flags become boolean, a missing id becomes the text ``None``."""
    rows = scores.select(
        F.coalesce(F.col("booking_id").cast("string"), F.lit("None")).alias("booking_id"),
        F.col("probability_of_cancellation").cast("double"),
        F.col("rank").cast("long"),
        F.col("risk_percentile").cast("double"),
        F.col("is_high_risk").cast("boolean"),
        "risk_segment",
    )
    _replace(rows, table, {"run_id": run_id, "model_name": model_name}, created_at)


def append_monitoring(
    metrics: DataFrame,
    table: str,
    run_type: str,
    model_name: str,
    run_id: str,
    created_at: Column | None = None,
) -> None:
    """Long metrics of one run, model and run type (``train``, ``batch_predict``, ...)."""
    rows = metrics.select("metric_name", F.col("metric_value").cast("double"))
    keys = {"run_id": run_id, "model_name": model_name, "run_type": run_type}
    _replace(rows, table, keys, created_at)


def append_model_run(
    metrics: DataFrame,
    params: dict,
    table: str,
    model_name: str,
    model_version: str,
    run_id: str,
    created_at: Column | None = None,
) -> None:
    """One row per training run and model: three metrics and the settings as JSON."""
    rows = metrics.select(
        F.lit(model_version).alias("model_version"),
        "accuracy",
        "f1",
        "roc_auc",
        F.lit(json.dumps(params, ensure_ascii=False)).alias("parameters_json"),
    )
    _replace(rows, table, {"run_id": run_id, "model_name": model_name}, created_at)
