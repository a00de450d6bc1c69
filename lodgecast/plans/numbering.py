"""Global and per-group row numbers without a single-partition window.

``row_number()`` over an unpartitioned window sends every row to one task, and over a
partitioned window a hot group does the same. Here rows are range-sorted instead, so a group of
any size spreads over as many slices as it needs:

1. ``orderBy`` gives contiguous, balanced slices; ``monotonically_increasing_id`` then carries
   (slice, place in slice) in one long. The sorted frame is written, which fixes both.
2. Rows are counted per slice (and group). A running total over these counts says how many rows
   of the group came in earlier slices. Per group that is at most one row per slice.
3. Row number = rows in earlier slices + place within the slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.plans.joins import BROADCAST_ROWS
from lodgecast.plans.storage import stored

_SLICE_BITS = 33  # Fixed value: monotonically_increasing_id keeps the row place in 33 bits.


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    within: Sequence[str] = (),
    position: str = "position",
    group_rows: str = "group_rows",
) -> DataFrame:
    """Add ``position`` (1-based along ``order``) and ``group_rows`` (rows in the group).

    ``within`` names grouping columns (null is a group too); without it the whole frame is one group. Keep
    ``df`` narrow: it is written twice. The first write fixes the input (range sorting reads it
    twice) and a spreading number, so even rows equal in every ordering column can be split
    over slices.
    """
    keys = list(within)
    fixed = stored(df.withColumn("_spread", F.monotonically_increasing_id()), "numbering-input")
    ordered = stored(
        fixed.orderBy(*[F.col(k) for k in keys], *order, F.col("_spread"))
        .drop("_spread")
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_place", _SLICE_BITS)),
        "numbering-sorted",
    )
    counts = ordered.groupBy("_slice", *keys).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    if keys:
        counts = stored(counts, "numbering-counts")
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_slice").alias("_at"),
        *[F.col(k).alias(f"_group{i}") for i, k in enumerate(keys)],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_rows").over(group).alias(group_rows),
    )
    same = F.col("_slice") == F.col("_at")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_group{i}"))
    # Without groups the offsets hold one row per slice, so their size is bounded by the number
    # of sort partitions. With groups it grows with the data: they are counted, and many are joined
    # by shuffle, where Spark by the size of the files might build either side on the driver. A
    # join key (slice, group) never holds more than one slice of rows.
    few = not keys or counts.count() <= BROADCAST_ROWS
    joined = ordered.join(F.broadcast(offsets) if few else offsets.hint("merge"), same)
    return joined.select(
        *df.columns, group_rows, (F.col("_place") + F.col("_shift")).alias(position)
    )


def running_total(df: DataFrame, order: str, value: str, total: str) -> DataFrame:
    """Add ``total``: the sum of ``value`` over the rows with a smaller ``order``.

    ``order`` is unique and not null. The rows are range-sorted and written; each slice adds up
    its own, and the sums of earlier slices (one row per slice) are broadcast.
    """
    ordered = stored(
        df.orderBy(order).withColumn("_slice", F.spark_partition_id()), "running-total"
    )
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ordered.groupBy("_slice").agg(F.sum(value).alias("_sum"))
    offsets = slices.select("_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        ordered.join(F.broadcast(offsets), "_slice")
        .withColumn(total, F.col("_before") + within)
        .drop("_slice", "_before")
    )
