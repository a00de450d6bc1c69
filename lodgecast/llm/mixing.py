"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times and some of them
once more. Which ones is a balanced sample: inclusion probabilities (the fraction of r) move
along directions that leave the totals of documents and of words unchanged, until all but a few
are 0 or 1. Documents are dealt to cells of bounded size by hash, each cell runs that flight on
its own, and the few documents it leaves open meet the leftovers of other cells in the next
round. These are as many as there are balancing totals, and ``LANDING`` documents of all sizes
that a cell leaves aside. In a source's last cell the landing picks the ends for them that miss
the totals least.

Only ids and sizes are shuffled, cells have a bounded number of rows however large a source is,
and the rounds number log(documents) to the base of a cell's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.common import null_safe_key, split_words, whole_text
from lodgecast.plans.joins import lookup_join
from lodgecast.plans.numbering import number_rows
from lodgecast.plans.storage import stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
CELL_ROWS = 8_192  # documents whose probabilities move together in one task
TOTALS = 2  # balanced totals: documents and words
LANDING = 12  # documents kept for the landing, which tries all their ends
_EDGE = 1e-9


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """``_llm_group, source, source_size, target`` per source of a frame with ``size``.

    Sources in code point order, null last, weigh ``weights`` in turn and share all of ``size``.
    A target stops at ``most`` times its source's size; what is cut is shared again by weight
    among the others until none is above. Each round is one sum over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = number_rows(sources, order, position="_llm_place", group_rows="_llm_sources")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.col("_llm_place") - 1) % len(weights) + 1).cast("int")
    )
    weighed = stored(
        ranked.select("source", "source_size", weight.alias("_llm_weight")), "mix-sources"
    )
    # target = min(most * size, level * weight); the level rises until nothing more is capped.
    level, capped = 0.0, -1
    while True:
        full = level * F.col("_llm_weight") > most * F.col("source_size")
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most * F.col("source_size"))).alias("cut"),
            F.sum(F.when(~full, F.col("_llm_weight"))).alias("weight"),
            F.count_if(full).alias("capped"),
        ).first()
        if not row["all"] or not row["weight"] or row["capped"] == capped:
            break
        capped = row["capped"]
        level = (row["all"] - (row["cut"] or 0)) / row["weight"]
    target = F.least((most * F.col("source_size")).cast("double"), F.lit(level) * F.col("_llm_weight"))
    return weighed.select(
        null_safe_key(F.col("source")).alias("_llm_group"),
        F.col("source_size"),
        target.alias("target"),
    )


def flight(sizes: list[int], chances: list[float], draws: list[float]) -> list[float]:
    """Move ``chances`` to 0 or 1 while sum(chance) and sum(size * chance) stay as they are.

    Three open documents at a time: their totals span two dimensions, so there is one direction
    (the cross product of the two rows) along which both totals stand still. The draw chooses
    which way to go along it, with the odds that keep every expected chance. Stops with at most
    ``TOTALS`` open documents, or earlier where all sizes are equal.
    """
    moved = list(chances)
    window: list[int] = []
    for place in [*range(len(moved)), None]:
        if place is None:
            break
        if _EDGE < moved[place] < 1 - _EDGE:
            window.append(place)
        while len(window) > TOTALS:
            a, b, c = window
            direction = (
                sizes[c] - sizes[b],
                sizes[a] - sizes[c],
                sizes[b] - sizes[a],
            )
            if not any(direction):  # equal sizes: any direction that keeps the sum
                direction = (1, -1, 0)
            up = min(
                (1 - moved[i]) / d if d > 0 else moved[i] / -d
                for i, d in zip(window, direction) if d
            )
            down = min(
                moved[i] / d if d > 0 else (1 - moved[i]) / -d
                for i, d in zip(window, direction) if d
            )
            step = up if draws[place] * (up + down) < down else -down
            for i, d in zip(window, direction):
                value = moved[i] + step * d
                moved[i] = 0.0 if value < _EDGE else 1.0 if value > 1 - _EDGE else value
            window = [i for i in window if 0.0 < moved[i] < 1.0]
    return moved


def landing(sizes: list[int], chances: list[float]) -> list[float]:
    """Ends for the few open documents with the least miss of the words, then of the documents."""
    open_at = [i for i, c in enumerate(chances) if 0.0 < c < 1.0]
    own = np.array([sizes[i] for i in open_at], float)
    kept = np.array([chances[i] for i in open_at])
    ends = (np.arange(2 ** len(open_at))[:, None] >> np.arange(len(open_at))) & 1
    missed = np.stack([np.abs(ends.sum(1) - kept.sum()), np.abs(ends @ own - own @ kept)])
    landed = list(chances)
    for i, end in zip(open_at, ends[np.lexsort(missed)[0]]):
        landed[i] = float(end)
    return landed


def fly(sizes: list[int], chances: list[float], draws: list[float], last: bool) -> list[float]:
    """One cell, sizes descending: a few documents of all sizes stay open in every round, so that
    the landing of the ``last`` cell has the means to meet the totals."""
    n = len(sizes)
    waiting = set(range(n) if n <= LANDING else np.linspace(0, n - 1, LANDING).astype(int).tolist())
    flying = [i for i in range(n) if i not in waiting]
    moved = list(chances)
    ends = flight(*([v[i] for i in flying] for v in (sizes, chances, draws)))
    for i, end in zip(flying, ends):
        moved[i] = end
    return landing(sizes, moved) if last else moved


def _fly(cell: pd.DataFrame) -> pd.DataFrame:
    """One cell: flight, and the landing too if the cell is all that is left of its source."""
    cell = cell.sort_values(
        ["size", "_llm_draw", "_llm_row"], ascending=[False, True, True], kind="stable"
    ).reset_index(drop=True)
    sizes, chances = cell["size"].tolist(), cell["_llm_chance"].tolist()
    draws = [((d * 0x9E3779B97F4A7C15) % 2**64) / 2**64 for d in cell["_llm_draw"].tolist()]
    cell["_llm_chance"] = fly(sizes, chances, draws, cell["_llm_cells"].iloc[0] == 1)
    return cell


def balanced_sample(units: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``_llm_row, _llm_once`` (0 or 1) for units with a chance strictly between 0 and 1.

    ``units`` has ``_llm_group``, ``_llm_row`` (unique), ``_llm_draw`` (a hash of the document),
    ``size`` and ``_llm_chance``. The documents' own hashes deal them to cells and drive the
    draws, so reruns and retried tasks agree.
    """
    left, done, rounds = units, [], 0
    while True:
        left = stored(left, "mix-left")
        rows = left.groupBy("_llm_group").agg(F.count(F.lit(1)).alias("_llm_rows"))
        # Half-full cells on average, so that uneven hashing does not overfill one.
        cells = F.greatest(F.lit(1), F.ceil(2 * F.col("_llm_rows") / cell_rows)).cast("long")
        rows = stored(rows.select("_llm_group", cells.alias("_llm_cells")), "mix-cells")
        most = rows.agg(F.max("_llm_cells")).first()[0]
        if most is None:
            break
        dealt = lookup_join(left, rows, ["_llm_group"]).withColumn(
            "_llm_cell", F.pmod(F.xxhash64("_llm_draw", F.lit(rounds)), F.col("_llm_cells"))
        )
        flown = dealt.groupBy("_llm_group", "_llm_cell").applyInPandas(_fly, dealt.schema)
        flown = stored(flown.drop("_llm_cells", "_llm_cell"), "mix-flown")
        at_end = F.col("_llm_chance").isin(0.0, 1.0)
        done.append(
            flown.filter(at_end).select("_llm_row", F.col("_llm_chance").cast("int").alias("_llm_once"))
        )
        if most == 1:
            break
        left, rounds = flown.filter(~at_end), rounds + 1
    sample = left.select("_llm_row", F.lit(0).alias("_llm_once")).limit(0)
    for ended in done:
        sample = sample.unionByName(ended)
    return sample


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    cell_rows: int = CELL_ROWS,
    carried: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``carried``) with ``_llm_size, _llm_source_size, _llm_target`` and ``_llm_times`` per row.

    The size is the number of words; ``_llm_times`` is how often the mix takes the row: 0 to
    ``most``, floor(target / source size) or one more. Empty and null texts have size 0 and
    count in the document total only; a source of nothing else has target 0 and is not taken.
    A null source is a source of its own. Repeated rows, null ids and ties are rows like any
    other. An empty table gives an empty table. ``docs`` is written once, with a number per row.
    """
    text, kept = whole_text(), carried or docs.columns
    draw = F.xxhash64(F.coalesce(F.col("doc_id"), F.col("_llm_row")), text, F.lit(7))
    rowed = stored(
        docs.withColumn("_llm_row", F.monotonically_increasing_id())
        .withColumn("_llm_size", F.size(split_words(text)).cast("long"))
        .withColumn("_llm_draw", draw)
        .select(*kept, F.col("source").alias("_llm_source"), "_llm_row", "_llm_size", "_llm_draw"),
        "mix-rows",
    )
    sized = rowed.select(
        "_llm_row",
        "_llm_draw",
        F.col("_llm_source").alias("source"),
        F.col("_llm_size").alias("size"),
    )
    targets = stored(source_targets(sized, weights, most), "mix-targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(times + _EDGE)
    chance = F.when(times - whole < _EDGE, 0.0).otherwise(times - whole)
    shared = targets.select(
        "_llm_group",
        F.col("source_size").alias("_llm_source_size"),
        F.col("target").alias("_llm_target"),
        whole.cast("int").alias("_llm_whole"),
        chance.alias("_llm_chance"),
    )
    keyed = sized.withColumn("_llm_group", null_safe_key(F.col("source")))
    units = (
        lookup_join(keyed, shared, ["_llm_group"])
        .filter(F.col("_llm_chance") > 0)
        .select("_llm_group", "_llm_row", "_llm_draw", "size", "_llm_chance")
    )
    sample = balanced_sample(units, cell_rows)
    grouped = rowed.withColumn("_llm_group", null_safe_key(F.col("_llm_source")))
    return (
        lookup_join(grouped, shared, ["_llm_group"], "left")
        .join(sample, "_llm_row", "left")
        .select(
            *kept,
            "_llm_size",
            "_llm_source_size",
            "_llm_target",
            (F.col("_llm_whole") + F.coalesce("_llm_once", F.lit(0))).alias("_llm_times"),
        )
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the same columns."""
    taken = mix_sources(docs, weights).filter(F.col("_llm_times") > 0)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("_llm_times")))
    return taken.withColumn("_llm_repeat", copies).select(*docs.columns)


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    return mix_sources(docs.select("doc_id", "source", "text"), carried=("doc_id",)).select(
        "doc_id",
        F.col("_llm_size").alias("size"),
        F.col("_llm_source_size").alias("source_size"),
        F.col("_llm_target").alias("target"),
        (F.col("_llm_size") * F.col("_llm_times")).cast("long").alias("taken"),
    )
