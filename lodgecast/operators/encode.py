"""Categorical columns of any width as numbers: places in an order, or label rates.

Values are counted by a distributed group-by and joined back, by broadcast while a column's values
are few and salted beyond, so neither the driver nor a model lists them, and no value is merged
with another however many there are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.functions.scoring import row_key, uniform_hash
from lodgecast.plans.joins import lookup_join
from lodgecast.plans.numbering import number_rows
from lodgecast.plans.storage import small_frame, stored
from lodgecast.schemas import LABEL, SEED

FOLDS = 5
SMOOTHING = 20.0  # rows at the overall rate that are added to each value


def _values(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """One row per row and column with a value: ``ids``, ``column``, ``value``."""
    return df.unpivot(list(ids), list(columns), "column", "value").filter("value IS NOT NULL")


def _looked_up(
    df: DataFrame, table: DataFrame, sizes: dict[str, int], column: str, found: Sequence[str]
) -> DataFrame:
    """``df`` with ``found`` of the column's rows in ``table``; null where the value is not there."""
    names = [f"{column}_{n}" for n in found]
    rows = table.filter(F.col("column") == column).select(
        F.col("value").alias(column), *[F.col(n).alias(f"{column}_{n}") for n in found]
    )
    joined = lookup_join(df, rows, [column], "left", rows_known=sizes.get(column, 0))
    return joined.select(*df.columns, *names)


@dataclass
class CategoryNumbers:
    """Each column's values numbered from 0 in alphabetical order: ``column, value, index``."""

    columns: list[str]
    table: DataFrame
    sizes: dict[str, int]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_index``; missing values and those unseen here get the next number."""
        for c in self.columns:
            next_number = F.lit(float(self.sizes.get(c, 0)))
            df = _looked_up(df, self.table, self.sizes, c, ["index"])
            df = df.withColumn(f"{c}_index", F.coalesce(f"{c}_index", next_number))
        return df


def number_categories(train: DataFrame, columns: Sequence[str]) -> CategoryNumbers:
    """Numbers for the values of ``columns``, which are strings. ``train`` is read once."""
    columns = list(columns)
    if not columns:
        return CategoryNumbers([], train.limit(0), {})
    distinct = _values(train, columns).distinct()
    ordered = number_rows(distinct, [F.col("value").asc()], ["column"], "number", "values")
    index = (F.col("number") - 1).cast("double").alias("index")
    table = stored(ordered.select("column", "value", index, "values"), "category-numbers")
    sizes = table.groupBy("column").agg(F.max("values").alias("n")).collect()  # one row per column
    return CategoryNumbers(columns, table, {r["column"]: r["n"] for r in sizes})


@dataclass
class LabelRates:
    """For each column's values the smoothed label rate and the share of rows.

    ``table`` has ``column, value, rows, positives``; ``rows`` and ``positives`` are the totals.
    """

    columns: list[str]
    table: DataFrame
    sizes: dict[str, int]
    rows: int
    positives: int
    smoothing: float

    @property
    def outputs(self) -> list[str]:
        return [f"{c}_{n}" for c in self.columns for n in ("rate", "share")]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_rate`` and ``<column>_share``; unseen and missing values get the overall
        rate and no share. ``df`` may be a stream."""
        overall = self.positives / self.rows if self.rows else 0.0
        table = self.table.select("column", "value", *_smoothed("rows", "positives", overall, self.rows, self.smoothing))
        for c in self.columns:
            df = _looked_up(df, table, self.sizes, c, ["rate", "share"])
            df = df.withColumns(
                {
                    f"{c}_rate": F.coalesce(f"{c}_rate", F.lit(overall)),
                    f"{c}_share": F.coalesce(f"{c}_share", F.lit(0.0)),
                }
            )
        return df

    def save(self, path: str) -> None:
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").parquet(f"{path}/values")
        kept = {k: getattr(self, k) for k in ("columns", "sizes", "rows", "positives", "smoothing")}
        small_frame(spark, [(json.dumps(kept),)], "value string").write.mode("overwrite").text(f"{path}/totals")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LabelRates:
        kept = json.loads(spark.read.text(f"{path}/totals", wholetext=True).first()["value"])
        return cls(table=spark.read.parquet(f"{path}/values"), **kept)


def _smoothed(rows: str, positives: str, overall: Column | float, total: Column | float, weight: float) -> list[Column]:
    overall, total = (x if isinstance(x, Column) else F.lit(float(x)) for x in (overall, total))
    rate = (F.col(positives) + F.lit(float(weight)) * overall) / (F.col(rows) + F.lit(float(weight)))
    share = F.coalesce(F.try_divide(F.col(rows), total), F.lit(0.0))
    return [rate.alias("rate"), share.alias("share")]


def fit_label_rates(
    train: DataFrame,
    columns: Sequence[str],
    label: str = LABEL,
    folds: int = FOLDS,
    smoothing: float = SMOOTHING,
    seed: int = SEED,
) -> tuple[LabelRates, DataFrame]:
    """(rates of all rows, ``train`` with the rates that its other folds give).

    A training row gets the rate of its value in the rows of other folds, so its own label is in
    none of its features; folds follow from the row's key, so rows of one key share a fold. Labels
    are 0 or 1. Missing values get the overall rate of the other folds. ``train`` is read twice:
    pass a stored frame.
    """
    columns = list(columns)
    fold = F.pmod(uniform_hash(row_key(train), f"{seed}-fold"), F.lit(folds)).cast("int")
    folded = train.withColumn("_fold", fold)
    counted = [F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positives")]
    totals = folded.groupBy("_fold").agg(*counted).collect()  # one row per fold
    rows, positives = (sum(r[n] for r in totals) for n in ("rows", "positives"))
    by_fold = stored(
        _values(folded, columns, ["_fold", label]).groupBy("column", "value", "_fold").agg(*counted)
        if columns
        else small_frame(train.sparkSession, [("", "", 0, 0, 0)], "column string, value string, _fold int, rows long, positives long").limit(0),
        "rates-by-fold",
    )
    whole = by_fold.groupBy("column", "value").agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))
    table = stored(whole, "label-rates")
    sizes = {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}
    rates = LabelRates(columns, table, sizes, rows, positives, smoothing)
    # What is left of the totals without a row's own fold.
    others = {r["_fold"]: (rows - r["rows"], positives - r["positives"]) for r in totals}
    overall, total = F.lit(0.0), F.lit(0.0)
    for k, (n, p) in others.items():
        overall = F.when(F.col("_fold") == k, F.lit(p / n if n else 0.0)).otherwise(overall)
        total = F.when(F.col("_fold") == k, F.lit(float(n))).otherwise(total)
    own = by_fold.withColumnsRenamed({"rows": "_rows", "positives": "_positives"})
    left = lookup_join(own, table, ["column", "value"], rows_known=sum(sizes.values()))
    left = left.withColumns({"rows": F.col("rows") - F.col("_rows"), "positives": F.col("positives") - F.col("_positives")})
    left = stored(
        left.select("column", "value", "_fold", *_smoothed("rows", "positives", overall, total, smoothing)), "rates-of-others"
    )
    sizes_by_fold = {r["column"]: r["count"] for r in left.groupBy("column").count().collect()}
    out = folded
    for c in columns:
        of_column = left.filter(F.col("column") == c).select(
            F.col("value").alias(c), "_fold", F.col("rate").alias(f"{c}_rate"), F.col("share").alias(f"{c}_share")
        )
        joined = lookup_join(out, of_column, [c, "_fold"], "left", rows_known=sizes_by_fold.get(c, 0))
        out = joined.select(*out.columns, f"{c}_rate", f"{c}_share").withColumns(
            {f"{c}_rate": F.coalesce(f"{c}_rate", overall), f"{c}_share": F.coalesce(f"{c}_share", F.lit(0.0))}
        )
    return rates, out.drop("_fold")
