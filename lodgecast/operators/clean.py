"""Cleaning: fill missing cells, count and drop duplicates, map the label, read the date.

The order is fixed: fill (over all rows, date and label strings included), then duplicates, then
label, then date, then rows without a date go, then features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.functions.dates import with_date
from lodgecast.functions.features import feature_columns
from lodgecast.operators.validate import drop_invalid_dates
from lodgecast.plans.selection import CANDIDATES, exact_quantiles
from lodgecast.plans.sketches import merge_sketches, quantiles_of
from lodgecast.plans.storage import small_frame, stored
from lodgecast.schemas import (
    DATE,
    DERIVED_COLUMNS,
    ID,
    LABEL,
    NUMERIC_COLUMNS,
    POSITION,
    STRING_COLUMNS,
)


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def with_double_numbers(df: DataFrame) -> DataFrame:
    """Numeric columns as double, NaN as null: a column with gaps has fractional medians."""
    return df.withColumns(
        {
            n: F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double"))
            for n in _present(df, NUMERIC_COLUMNS)
        }
    )


def medians(
    df: DataFrame, columns: Sequence[str], approx: bool = False, limit: int = CANDIDATES
) -> dict[str, float | None]:
    """Median per column, exact unless ``approx``."""
    if not columns:
        return {}
    if approx:
        return df.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in columns]).first().asDict()
    return {c: v[0] for c, v in exact_quantiles(df, list(columns), [0.5], limit).items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per string column, the smallest on ties, ``None`` without values.

    Values are counted per (column, value) with map-side combining; one pair per column is kept.
    """
    if not columns:
        return {}
    counted = (
        df.select(*columns)
        .unpivot([], list(columns), "name", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    best = counted.groupBy("name").agg(F.min(F.struct(-F.col("rows"), "value")).alias("best"))
    found = {r["name"]: r["best"]["value"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in columns}


def _kept_medians(sketches: DataFrame) -> dict[str, float | None]:
    """Median of each booking column that has sketches, over all of them together."""
    merged = merge_sketches(sketches).select("feature", quantiles_of([0.5]).alias("q"))
    found = {r["feature"]: r["q"] and r["q"][0] for r in merged.collect()}  # one row per feature
    return {n: found[n] for n in NUMERIC_COLUMNS if n in found}


def _batch_values(df: DataFrame, approx: bool = False) -> dict:
    numeric, strings = _present(df, NUMERIC_COLUMNS), _present(df, STRING_COLUMNS)
    return {**medians(with_double_numbers(df), numeric, approx), **modes(df, strings)}


def imputation_stats(
    df: DataFrame, approx: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    """One row: the median of each numeric column and the mode of each string column.

    ``df`` is read a few times; pass a file scan or a stored frame. With ``sketches`` (kept ones
    of any runs, see ``plans.sketches``) the medians come from those instead of from ``df``.
    """
    values = _batch_values(df, approx) if sketches is None else {**_kept_medians(sketches), **modes(df, _present(df, STRING_COLUMNS))}
    schema = ", ".join(f"{n} {'double' if n in NUMERIC_COLUMNS else 'string'}" for n in values)
    return small_frame(df.sparkSession, [tuple(values.values())], schema)


def _fill(df: DataFrame, values: dict) -> DataFrame:
    known = {n: v for n, v in values.items() if v is not None}
    return df.fillna(known) if known else df


def impute_median(df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Fill missing numbers with column medians (of ``df`` itself unless ``stats`` is given)."""
    numbers = with_double_numbers(df)
    values = (
        medians(numbers, columns) if stats is None else stats.select(*columns).first().asDict()
    )
    return _fill(numbers, values)


def impute_mode(df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Fill missing strings with the most frequent value."""
    values = modes(df, columns) if stats is None else stats.select(*columns).first().asDict()
    return _fill(df, values)


def impute(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Median and mode filling of every booking column present."""
    values = _batch_values(df) if stats is None else stats.first().asDict()
    return _fill(with_double_numbers(df), {n: v for n, v in values.items() if n in df.columns})


def _copies(df: DataFrame) -> DataFrame:
    """One row per group of rows equal in all but id and position, with ``copies``.

    The kept id is the one at the first input position if that column is there, otherwise the
    smallest. Grouping is null-safe and combined before the shuffle, so a large group costs one
    row per task.
    """
    content = [c for c in df.columns if c not in (ID, POSITION)]
    kept = []
    if POSITION in df.columns:
        kept.append(F.min(POSITION).alias(POSITION))
    if ID in df.columns:
        first = F.min(F.struct(POSITION, ID)).getField(ID) if POSITION in df.columns else F.min(ID)
        kept.append(first.alias(ID))
    # A minimum of texts is aggregated by sorting; the hash in front settles nearly all of it.
    hashed = F.xxhash64(*content).alias("_hash")
    return df.groupBy(hashed, *content).agg(*kept, F.count(F.lit(1)).alias("copies")).drop("_hash")


def count_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat another row in every column but the id."""
    return _copies(df).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_count")
    )


def dedupe_bookings(df: DataFrame) -> DataFrame:
    """One row per duplicate group: the first by input position, else the smallest id."""
    return _copies(df).select(*df.columns)


def label_number(label: Column) -> Column:
    """Canceled 1, Not_Canceled 0, anything else null."""
    return F.when(label == "Canceled", 1).when(label == "Not_Canceled", 0)


def encode_label(df: DataFrame) -> DataFrame:
    return df.withColumn(LABEL, label_number(F.col(LABEL)))


def parse_reservation_date(df: DataFrame) -> DataFrame:
    """Add ``reservation_date`` from the date string."""
    return with_date(df, DATE)


def count_invalid_dates(df: DataFrame) -> DataFrame:
    """Rows whose (filled) date string cannot be read."""
    return with_date(df, DATE, "_date").agg(F.count_if(F.col("_date").isNull()).alias("invalid_dates_count"))


def booking_features(df: DataFrame) -> DataFrame:
    """Add the ten derived features from canonical columns and ``reservation_date``."""
    return df.withColumns(feature_columns())


@dataclass
class Cleaned:
    """Result of :func:`preprocess_bookings`; the frames are lazy.

    ``counts`` has the summary's records before and after and its invalid dates. When scoring it
    is one pass over the rows, while the summary also looks for duplicates.
    """

    frame: DataFrame
    rejected: DataFrame
    summary: DataFrame
    counts: DataFrame


def preprocess_bookings(
    df: DataFrame,
    is_training: bool = True,
    stats: DataFrame | None = None,
    store_groups: bool = False,
) -> Cleaned:
    """Clean and derive features. Training also drops duplicates and maps the label.

    Without ``stats`` missing cells are filled from the batch's own statistics. ``rejected``
    holds the rows whose date cannot be read. The date column leaves; the id stays, last, as
    does an input position. ``store_groups`` writes the duplicate groups once, for callers that
    read several of the results.
    """
    filled = impute(df, stats)
    groups = _copies(filled)
    if store_groups:
        groups = stored(groups, "duplicate-groups")
    kept = groups.drop("copies") if is_training else filled
    if LABEL in kept.columns:
        kept = encode_label(kept)
    dated = parse_reservation_date(kept)
    carried = [c for c in (ID, POSITION) if c in filled.columns]
    content = [c for c in filled.columns if c not in (DATE, *carried)]
    frame = booking_features(drop_invalid_dates(dated)).select(*content, *DERIVED_COLUMNS, *carried)
    rejected = dated.filter(F.col("reservation_date").isNull()).drop("reservation_date")
    before = [c for c in filled.columns if c != POSITION]
    after = [c for c in frame.columns if c != POSITION]
    summary = preprocess_summary(groups, before, after, is_training)
    counts = summary if is_training else plain_counts(filled)
    return Cleaned(frame, rejected, summary, counts)


def plain_counts(df: DataFrame) -> DataFrame:
    """One row: records, records with a readable date, and the others, in one pass."""
    unread = F.col("_date").isNull()
    return with_date(df, DATE, "_date").agg(
        F.count(F.lit(1)).alias("records_before"),
        F.count_if(~unread).alias("records_after"),
        F.count_if(unread).alias("invalid_dates_count"),
    )


def preprocess_summary(
    groups: DataFrame, before: Sequence[str], after: Sequence[str], is_training: bool
) -> DataFrame:
    """One row of shapes and counts, from one pass over the duplicate groups."""
    marked = with_date(groups, DATE, "_date").withColumn("_bad", F.col("_date").isNull())
    weight = F.lit(1).cast("long") if is_training else F.col("copies")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0).cast("long"))

    counted = marked.agg(
        total(F.col("copies")).alias("records_before"),
        total(F.when(~F.col("_bad"), weight)).alias("records_after"),
        total(F.col("copies") - 1).alias("duplicates_count"),
        total(F.when(F.col("_bad"), weight)).alias("invalid_dates_count"),
    )
    return counted.select(
        "records_before",
        F.lit(len(before)).alias("columns_before"),
        "records_after",
        F.lit(len(after)).alias("columns_after"),
        "duplicates_count",
        "invalid_dates_count",
        _names(set(after) - set(before)).alias("added_features"),
        _names(set(before) - set(after)).alias("removed_features"),
    )


def _names(names: set[str]) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)])
