"""Exact order statistics of many columns without sorting or shuffling the rows.

``median`` / ``percentile`` keep every distinct value of a column in one task. Here a mergeable
sketch (``percentile_approx``) only proposes a narrow interval, exact counts confirm that the
wanted position lies inside, and the step repeats on that interval until few values are left.
Each round is one aggregation with a small fixed-size state, so rounds grow with log(rows).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 200_000  # values of one column that may meet in a single task
_ACCURACY = 1_000


@dataclass
class _Target:
    """Position ``index`` (0-based, ascending) of ``column``.

    ``value`` once known; until then it lies strictly between ``low`` and ``high`` (None: no
    bound), with ``below`` values up to ``low`` and ``rows`` values in between.
    """

    column: str
    index: int
    rows: int
    below: int = 0
    low: Any = None
    high: Any = None
    value: Any = None
    slack: float = 2.0 / _ACCURACY

    def inside(self) -> Column:
        value = F.col(self.column)
        if self.low is None and self.high is None:
            return value.isNotNull()
        kept = F.lit(True)
        if self.low is not None:
            kept = kept & (value > F.lit(self.low))
        if self.high is not None:
            kept = kept & (value < F.lit(self.high))
        return kept


def count_values(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Non-null count of each column, in one aggregation."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def order_statistics(
    df: DataFrame, wanted: dict[str, list[int]], counts: dict[str, int], limit: int = CANDIDATES
) -> dict[tuple[str, int], Any]:
    """Value at each wanted 0-based ascending position; nulls are not counted.

    ``df`` is read a few times, so pass a file scan or a stored frame. The driver sees one row
    of interval bounds per round and one value per wanted position.
    """
    targets = [
        _Target(column, index, counts[column])
        for column, indexes in wanted.items()
        for index in sorted(set(indexes))
    ]
    for target in targets:
        if not 0 <= target.index < target.rows:
            raise ValueError(f"{target.column} has {target.rows} values, none at {target.index}")
    while True:
        wide = [t for t in targets if t.value is None and t.rows > limit]
        if not wide:
            return _read_off(df, targets)
        _narrow(df, wide)


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    proposed = _propose(df, targets)
    # Targets that were proposed the same interval share its counts.
    intervals = sorted({(t.column, low, high) for t, (low, high) in zip(targets, proposed)})
    checks = []
    for i, (column, low, high) in enumerate(intervals):
        value = F.col(column)
        checks += [
            F.count_if(value < F.lit(low)).alias(f"below{i}"),
            F.count_if(value == F.lit(low)).alias(f"low{i}"),
            F.count_if((value > F.lit(low)) & (value < F.lit(high))).alias(f"rows{i}"),
            F.count_if(value == F.lit(high)).alias(f"high{i}"),
        ]
    counted = df.agg(*checks).first()
    for t, (low, high) in zip(targets, proposed):
        i = intervals.index((t.column, low, high))
        below, at_low, rows, at_high = (counted[f"{n}{i}"] for n in ("below", "low", "rows", "high"))
        place = t.index - below
        if 0 <= place < at_low:
            t.value = low
        elif at_low <= place < at_low + rows:
            t.low, t.high, t.below, t.rows = low, high, below + at_low, rows
        elif at_low + rows <= place < at_low + rows + at_high and low != high:
            t.value = high
        else:  # The sketch missed: ask for a wider interval.
            t.slack *= 4


def _propose(df: DataFrame, targets: list[_Target]) -> list[tuple[Any, Any]]:
    """An interval around each target; targets of one span share a sketch."""
    spans: dict[tuple, list[int]] = {}
    for i, t in enumerate(targets):
        spans.setdefault((t.column, t.low, t.high), []).append(i)
    sketches = []
    for n, members in enumerate(spans.values()):
        shares = []
        for t in (targets[i] for i in members):
            share = (t.index - t.below) / t.rows
            shares += [max(0.0, share - t.slack), min(1.0, share + t.slack)]
        values = F.when(targets[members[0]].inside(), F.col(targets[members[0]].column))
        sketches.append(F.percentile_approx(values, shares, _ACCURACY).alias(f"s{n}"))
    row = df.agg(*sketches).first()
    proposed: dict[int, tuple[Any, Any]] = {}
    for n, members in enumerate(spans.values()):
        for place, i in enumerate(members):
            proposed[i] = (row[n][2 * place], row[n][2 * place + 1])
    return [proposed[i] for i in range(len(targets))]


def _read_off(df: DataFrame, targets: list[_Target]) -> dict[tuple[str, int], Any]:
    found = {(t.column, t.index): t.value for t in targets if t.value is not None}
    open_targets = [t for t in targets if t.value is None]
    # Columns of one type share a pass; unlike types cannot share the value column.
    for kind in sorted({df.schema[t.column].dataType.simpleString() for t in open_targets}):
        group = [t for t in open_targets if df.schema[t.column].dataType.simpleString() == kind]
        found.update(_read_off_one_type(df, group))
    return found


def _read_off_one_type(df: DataFrame, targets: list[_Target]) -> dict[tuple[str, int], Any]:
    spans = list({(t.column, t.low, t.high): t for t in targets}.values())
    number = {(t.column, t.low, t.high): i for i, t in enumerate(spans)}
    cells = F.array(
        *[F.when(t.inside(), F.struct(F.lit(i).alias("span"), F.col(t.column).alias("value")))
          for i, t in enumerate(spans)]
    )
    histogram = (
        df.select(F.explode(F.array_compact(cells)).alias("cell"))  # most cells of a row are null
        .select("cell.*")
        .groupBy("span", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # At most ``limit`` values per span reach this window.
    running = Window.partitionBy("span").orderBy("value")
    upto = F.sum("rows").over(running)
    steps = histogram.select("span", "value", (upto - F.col("rows")).alias("start"), upto.alias("end"))
    hit = F.lit(False)
    for t in targets:
        at = t.index - t.below
        span = number[t.column, t.low, t.high]
        hit = hit | ((F.col("span") == span) & (F.col("start") <= at) & (F.col("end") > at))
    found = {}
    rows = steps.filter(hit).collect()
    for t in targets:
        at, span = t.index - t.below, number[t.column, t.low, t.high]
        found[t.column, t.index] = next(
            r["value"] for r in rows if r["span"] == span and r["start"] <= at < r["end"]
        )
    return found


def exact_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], limit: int = CANDIDATES
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns; ``None`` for a column without values.

    Columns counted to hold at most ``limit`` values use Spark's ``percentile``, which keeps
    them in one task; larger ones go through :func:`order_statistics`.
    """
    counts = count_values(df, columns)
    found: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    small = [c for c in columns if 0 < counts[c] <= limit]
    if small:
        row = df.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in small]).first()
        found.update({c: list(row[c]) for c in small})
    large = [c for c in columns if counts[c] > limit]
    if large:
        found.update(_large_quantiles(df, large, shares, counts, limit))
    return found


def _large_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], counts: dict[str, int], limit: int
) -> dict[str, list[float | None]]:
    places = {c: [share * (counts[c] - 1) for share in shares] for c in columns}
    neighbours = {
        c: [(int(p), min(int(p) + 1, counts[c] - 1), p - int(p)) for p in spots]
        for c, spots in places.items()
    }
    wanted = {c: sorted({i for a, b, _ in n for i in (a, b)}) for c, n in neighbours.items()}
    at = order_statistics(df, wanted, counts, limit)
    return {
        c: [
            float(at[c, a]) if at[c, a] == at[c, b] else (1 - part) * at[c, a] + part * at[c, b]
            for a, b, part in n
        ]
        for c, n in neighbours.items()
    }


def text_at(df: DataFrame, column: str, index: int, limit: int = CANDIDATES) -> str | None:
    """Value at 0-based position ``index`` of a text column in ascending order, nulls first.

    The position is narrowed by counting prefixes, two characters more each round, until few
    values or one are left. ``df`` is read once per round; the driver sees one row per prefix.
    """
    nulls = df.filter(F.col(column).isNull()).count()
    if index < nulls:
        return None
    left, prefix = index - nulls, ""
    while True:
        inside = df.filter(F.col(column).startswith(prefix))
        width = len(prefix) + 2
        counted = inside.groupBy(F.substring(column, 1, width).alias("prefix")).agg(
            F.count(F.lit(1)).alias("rows")
        )
        # Code point order is the order of the texts' bytes.
        for row in sorted(counted.collect(), key=lambda r: r["prefix"]):
            if left < row["rows"]:
                break
            left -= row["rows"]
        else:
            raise ValueError(f"{column} has no value at {index}")
        prefix = row["prefix"]
        if len(prefix) < width:  # nothing follows: all of them are this text
            return prefix
        if row["rows"] <= limit:
            values = F.sort_array(F.collect_list(column))
            kept = df.filter(F.col(column).startswith(prefix)).agg(values.alias("v"))
            return kept.select(F.get("v", F.lit(left))).first()[0]
