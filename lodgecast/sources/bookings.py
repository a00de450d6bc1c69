"""Bookings from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.schemas import (
    CANONICAL_TO_WIRE,
    MISSING_TOKENS,
    NUMERIC_COLUMNS,
    POSITION,
    WIRE_TO_CANONICAL,
    wire_text_schema,
)


def rename_bookings(df: DataFrame, to: str = "canonical") -> DataFrame:
    """Rename columns between wire and canonical names; unknown names are left alone."""
    if to == "canonical":
        return df.withColumnsRenamed(WIRE_TO_CANONICAL)
    if to == "wire":
        return df.withColumnsRenamed(CANONICAL_TO_WIRE)
    raise ValueError(f"to must be 'canonical' or 'wire', not {to!r}")


def read_bookings_csv(
    spark: SparkSession,
    path: str,
    labelled: bool = True,
    position: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Header CSV in wire names. Missing-value tokens become null, numbers become double.

    Columns are matched by header name; all files of ``path`` have the same header, which may
    lack the id. Rows with too few or too many cells fail the read. ``multiline`` allows line
    breaks inside quoted cells, at the price of one task per file; without it they fail too.
    ``position`` adds ``input_position``, which sorts rows by file and place in the file.
    """
    header = spark.read.option("header", True).csv(path).columns
    unread = [f.name for f in wire_text_schema(labelled) if f.name not in header]
    required = [n for n in unread if n != "Booking_ID"]
    if required:
        raise ValueError(f"{path} lacks columns {required}")
    text = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", "FAILFAST")
        .schema(", ".join(f"`{name}` string" for name in header))
        .csv(path)
    )
    # All cells are read, so that a row of another length is noticed under column pruning too.
    wanted = [f.name for f in wire_text_schema(labelled) if f.name in header]
    cells = [_cell(name).alias(WIRE_TO_CANONICAL[name]) for name in wanted]
    if position:
        # Within one file block the rows of a task are numbered in reading order.
        cells.append(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias(POSITION)
        )
    return text.select(*cells)


def _cell(wire: str) -> Column:
    column = F.col(f"`{wire}`")
    present = F.when(~column.isin(MISSING_TOKENS), column)
    if WIRE_TO_CANONICAL[wire] in NUMERIC_COLUMNS:
        # An unparseable or NaN number is a missing number.
        return F.nanvl(F.trim(present).try_cast("double"), F.lit(None).cast("double"))
    return present
