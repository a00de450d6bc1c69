"""Joins of many rows to a smaller table whose keys may be hot on the large side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.plans.storage import stored

BROADCAST_ROWS = 20_000  # the driver builds the table whole, and a plan may hold several
SALTS = 32
SALTED_ROWS = 2_000_000  # of a table repeated for its salts; larger tables get fewer salts


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    rows_known: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table``: broadcast if it is counted to be small, by shuffle otherwise.

    ``rows_known`` is the table's counted number of rows, where the caller has it; the table is a
    scan then, and is not written and counted here.

    Salted: each row goes to one of ``salts`` parts of its key, chosen by its content, and the
    table is repeated once per part. The salt comes from the row itself, so a repeated task
    sends the row to the same part; rows equal in every column share a part. A table is repeated
    to ``SALTED_ROWS`` rows at most; beyond that hot keys are left to AQE, which splits them.

    The shuffle is asked for by a hint: Spark takes a table for as small as its files, does not
    see that it is repeated, and would build it on the driver.
    """
    keys = list(keys)
    if rows_known is None:
        table = stored(table, "lookup")  # counted and joined, so computed once
        rows_known = table.count()
    if rows_known <= broadcast_rows:
        return rows.join(F.broadcast(table), keys, how)
    salts = min(salts, SALTED_ROWS // rows_known)
    if salts < 2:
        return rows.join(table.hint("merge"), keys, how)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    salted_table = table.withColumn("_salt", parts)
    return salted_rows.join(salted_table.hint("merge"), [*keys, "_salt"], how).drop("_salt")
