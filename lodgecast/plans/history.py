"""Running totals of earlier rows per key, split by calendar day.

A window over a key sends all rows of a hot key to one task. Totals are therefore taken in two
steps: per (key, day) in the shuffle's map side, then a running total over the days of a key
(bounded by the calendar, not by the rows), then the rows of one (key, day), which are cut into
slices where they are too many for a task (see ``plans.segments``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.plans.segments import GROUP_ROWS, totals_before
from lodgecast.plans.storage import stored


def earlier_totals(
    df: DataFrame,
    key: str,
    moment: str,
    totals: dict[str, Column],
    tie_break: Sequence[str] = (),
    lookup: DataFrame | None = None,
    most: int = GROUP_ROWS,
) -> DataFrame:
    """Add, per row, the totals over strictly earlier rows of the same ``key`` (0 if none).

    Rows are ordered by ``moment`` then ``tie_break``; rows without a key or moment are kept and
    have no earlier rows. ``lookup`` (one row per ``key``) is joined at the day level, where a
    hot key has few rows, instead of on the rows themselves; rows it lacks are dropped. A (key,
    day) of more than ``most`` rows is spread over tasks. ``df`` is read twice, and the counts of
    its days are taken when this is called.
    """
    known = F.col(key).isNotNull() & F.col(moment).isNotNull()
    dated = df.filter(known).withColumns(
        {"_day": F.to_date(moment), **{f"_one_{n}": value for n, value in totals.items()}}
    )
    days = dated.groupBy(key, "_day").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_one_{n}").alias(f"_sum_{n}") for n in totals]
    )
    days = stored(days, "days")
    before_day = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    earlier_days = days.select(
        key, "_day", *[F.sum(f"_sum_{n}").over(before_day).alias(f"_days_{n}") for n in totals]
    )
    if lookup is not None:
        earlier_days = earlier_days.join(lookup, key)
    placed = totals_before(
        dated,
        [key, "_day"],
        [moment, *tie_break],
        {f"_rows_{n}": F.col(f"_one_{n}") for n in totals},
        days,
        most,
    )
    kept = [*df.columns, *([c for c in lookup.columns if c != key] if lookup is not None else [])]
    none = F.lit(0)
    counted = placed.join(earlier_days, [key, "_day"], "left" if lookup is None else "inner").select(
        *kept, *[(F.coalesce(f"_days_{n}", none) + F.col(f"_rows_{n}")).alias(n) for n in totals]
    )
    if lookup is not None:
        return counted
    # Rows without key or moment have no place in any order and stay out of the windows.
    kinds = dict(counted.dtypes)
    unplaced = df.filter(~known).select(*df.columns, *[none.cast(kinds[n]).alias(n) for n in totals])
    return counted.unionByName(unplaced)
