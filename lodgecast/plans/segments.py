"""Running totals inside groups of any size: groups with too many rows are cut into range slices.

A window over a group is one task. Groups of up to ``most`` rows stay as they are. The rows of the
others are range-partitioned along the group's order, so that a group spreads over as many slices
as it needs; a slice adds up its own rows, and the totals of the group's earlier slices, one row
per slice, are joined to it. Which way a group goes follows from its counted rows and changes no
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.plans.joins import lookup_join
from lodgecast.plans.storage import stored

GROUP_ROWS = 500_000  # rows one task may order; a window of that size spills to disk if it has to
MOST_SLICES = 10_000


def totals_before(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    counts: DataFrame,
    most: int = GROUP_ROWS,
) -> DataFrame:
    """Add, per row, the totals of ``values`` over the earlier rows of its group (0 if none).

    ``counts`` has the ``groups`` columns, which are not null, and ``_rows``. Rows equal in all
    ``order`` columns follow each other in any order; nulls in them come first. The rows of large
    groups are written twice, those of others not at all.
    """
    groups = list(groups)
    large = counts.filter(F.col("_rows") > most)
    total = large.agg(F.sum("_rows")).first()[0]
    if not total:
        return _within(df, groups, order, values)
    large = stored(large.select(*groups), "large-groups")
    small = _within(lookup_join(df, large, groups, "left_anti"), groups, order, values)
    # Written, so that slices are cut from the rows that are sampled for them.
    members = lookup_join(df, large, groups, "left_semi")
    members = stored(members.withColumn("_spread", F.monotonically_increasing_id()), "large-group-rows")
    slices = min(MOST_SLICES, -(-total // most))
    sliced = stored(
        members.repartitionByRange(slices, *groups, *order, "_spread").withColumn(
            "_slice", F.spark_partition_id()
        ),
        "slices",
    )
    keys = [*groups, "_slice"]
    sums = sliced.groupBy(*keys).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, *[F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in values])
    inside = _within(sliced, keys, [*order, "_spread"], values)
    joined = lookup_join(inside, before, keys, "left")
    added = {n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in values}
    return small.unionByName(joined.withColumns(added).select(*small.columns))


def _within(df: DataFrame, groups: list[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    so_far = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[F.coalesce(F.sum(v).over(so_far), F.lit(0)).alias(n) for n, v in values.items()])
