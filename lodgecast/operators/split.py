"""Repeatable stratified splits with exact class quotas and no shuffle of the rows.

Every row gets a number from its id. Inside a class the rows with the smallest numbers form the
test set; the number at the quota is found by counting (see ``plans.selection``), after which
membership is a comparison on the row itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.functions.scoring import row_key, uniform_hash
from lodgecast.plans.selection import CANDIDATES, order_statistics
from lodgecast.schemas import LABEL, SEED, TEST_SIZE


def class_quotas(counts: dict[int, int], size: float) -> dict[int, int]:
    """Share of ``ceil(rows x size)`` held-out rows per class.

    The remaining rows go to classes in proportion, leftovers to the largest fractions and
    then the smaller label; what is left of each class is held out.
    """
    rows = sum(counts.values())
    remaining = rows - math.ceil(rows * size)
    exact = {label: remaining * n / rows for label, n in counts.items()}
    kept = {label: math.floor(x) for label, x in exact.items()}
    spare = remaining - sum(kept.values())
    for label in sorted(exact, key=lambda c: (kept[c] - exact[c], c))[:spare]:
        kept[label] += 1
    return {label: counts[label] - kept[label] for label in counts}


def _parts(df: DataFrame, sizes: dict[str, float], label: str, seed: int, limit: int) -> DataFrame:
    """Add ``split``: parts of ``sizes`` are cut off in turn, the rest is ``train``."""
    numbered = df.withColumn("_number", uniform_hash(row_key(df), seed))
    counts = {
        row[label]: row["rows"]
        for row in numbered.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).collect()
    }
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no {label}; drop or repair them before a split")
    left, ends = dict(counts), {c: [] for c in counts}
    for size in sizes.values():
        quota = class_quotas(left, size)
        for c in counts:
            ends[c].append((ends[c][-1] if ends[c] else 0) + quota[c])
            left[c] -= quota[c]
    classes = sorted(counts)
    wide = numbered.select(
        *[F.when(F.col(label) == c, F.col("_number")).alias(f"n{i}") for i, c in enumerate(classes)]
    )
    wanted = {f"n{i}": [e - 1 for e in ends[c] if e] for i, c in enumerate(classes)}
    cuts = order_statistics(
        wide, wanted, {f"n{i}": counts[c] for i, c in enumerate(classes)}, limit
    )
    part = F.lit("train")
    for which, name in reversed(list(enumerate(sizes))):
        member = F.lit(False)
        for i, c in enumerate(classes):
            if ends[c][which]:
                last = cuts[f"n{i}", ends[c][which] - 1]
                member = member | ((F.col(label) == c) & (F.col("_number") <= last))
        part = F.when(member, F.lit(name)).otherwise(part)
    return numbered.withColumn("split", part).drop("_number")


def split_stratified(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    label: str = LABEL,
    limit: int = CANDIDATES,
) -> DataFrame:
    """Add ``split`` = train / test with the class shares kept.

    Rows sharing an id fall on the same side. ``df`` is read a few times: pass a stored frame.
    """
    return _parts(df, {"test": test_size}, label, seed, limit)


def split_three_way(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    validation_size: float = TEST_SIZE,
    seed: int = SEED,
    label: str = LABEL,
    limit: int = CANDIDATES,
) -> DataFrame:
    """Add ``split`` = train / validation / test; the second size is a share of what test left."""
    return _parts(df, {"test": test_size, "validation": validation_size}, label, seed, limit)
