"""Quantile sketches that are kept and merged: one small binary per feature and day, run or batch.

An exact quantile needs the rows; a kept sketch stands in for them. Sketches are made with map-side
combining, so a group of any size sends one sketch per task, and merging days, runs or stream
batches reads sketches only. A quantile taken from a sketch of any number of rows or merges has a
rank within :func:`rank_error` of the wanted one (in 99 of 100 cases); up to ``k`` values it is
exact. ``plans.selection`` stays for exact results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 1_000  # k of the sketches, some 20 kB each


def rank_error(k: int = SIZE) -> float:
    """How far shares read from a sketch may be off; the published fit for these sketches."""
    return 2.446 / k**0.9433


def sketch_columns(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = SIZE
) -> DataFrame:
    """``by``, ``feature, sketch, rows, missing``: one row per group and numeric column.

    Nulls and NaN are counted as missing and are not in the sketch. ``df`` is read once. Without
    rows there are no groups, and without ``by`` and rows no features.
    """
    by = list(by)
    doubles = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    return (
        doubles.unpivot(by, list(columns), "feature", "value")
        .groupBy(*by, "feature")
        .agg(
            F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"),
            F.count("value").alias("rows"),
            F.count_if(F.col("value").isNull()).alias("missing"),
        )
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same per ``by`` and feature; columns that are not in ``by`` are merged away."""
    return sketches.groupBy(*by, "feature").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
    )


def quantiles_of(shares: Sequence[float], sketch: str = "sketch", rows: str = "rows") -> Column:
    """Array of the quantiles at ``shares`` of a sketch, null where it holds nothing."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    return F.when(F.col(rows) > 0, F.kll_sketch_get_quantile_double(sketch, wanted))


def shares_up_to(values: Sequence[float], sketch: str = "sketch", rows: str = "rows") -> Column:
    """Array of the shares of a sketch's rows up to each value; 0 where it holds nothing."""
    if not values:
        return F.array().cast("array<double>")
    wanted = F.array(*[F.lit(float(v)) for v in values])
    nothing = F.array(*[F.lit(0.0) for _ in values])
    return F.when(F.col(rows) > 0, F.kll_sketch_get_rank_double(sketch, wanted)).otherwise(nothing)


def keep_sketches(sketches: DataFrame, path: str, run: str) -> None:
    """Write the sketches of one run, day or batch; writing the same again replaces them."""
    sketches.write.mode("overwrite").parquet(f"{path}/run={run}")


def kept_sketches(spark: SparkSession, path: str) -> DataFrame:
    """All kept sketches, with the column ``run``."""
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))
