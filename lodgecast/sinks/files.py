"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodgecast.operators.rank import filter_high_risk


def _write(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"format must be 'parquet' or 'csv', not {fmt!r}")


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The cleaned training set."""
    _write(df, path, fmt)


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The whole score table; files cover successive ranges of ranks."""
    _write(scores.orderBy("rank"), path, fmt)


def write_high_risk(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The flagged rows only."""
    _write(filter_high_risk(scores).orderBy("rank"), path, fmt)
