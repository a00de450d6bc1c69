"""Words, whole texts and small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"  # Fixed value: the white space that separates words.
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def split_words(text: Column) -> Column:
    """Words of a text in order; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_RUN)
    )


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` is much faster than ``translate`` but also changes other letters, so it only
    serves strings that are ASCII throughout (as many bytes as characters).
    """
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def wide_hash(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they identify a value at corpus size."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(0x9E3779B9), *values)]


def null_safe_key(*values: Column) -> Column:
    """One non-null string per combination of values, null being a value of its own."""
    parts = [
        F.coalesce(
            F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")),
            F.lit("-"),
        )
        for v in values
    ]
    return F.concat_ws("|", *parts)
