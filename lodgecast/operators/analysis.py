"""Reports over cleaned and scored bookings."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.functions.scoring import row_key, scorecard_probability, uniform_hash
from lodgecast.operators.clean import count_duplicates, parse_reservation_date
from lodgecast.operators.rank import PROBABILITY
from lodgecast.operators.validate import is_invalid
from lodgecast.plans.history import earlier_totals
from lodgecast.plans.joins import lookup_join
from lodgecast.plans.segments import GROUP_ROWS
from lodgecast.plans.selection import exact_quantiles
from lodgecast.plans.sketches import quantiles_of, shares_up_to
from lodgecast.plans.storage import small_frame
from lodgecast.schemas import CATEGORY_COLUMNS, DATE, FEATURE_COLUMNS, ID, LABEL

PSI_FLOOR = 1e-4  # share given to an empty bucket


def score_scorecard(features: DataFrame) -> DataFrame:
    """Add the fixed logistic scorecard's probability to cleaned bookings."""
    return features.withColumn(PROBABILITY, scorecard_probability())


def lift_at_share(scores: DataFrame, label: str = LABEL) -> DataFrame:
    """Cancel rate among flagged rows over the overall cancel rate."""
    flagged = F.when(F.col("is_high_risk") == 1, F.col(label))
    rates = scores.agg(
        F.count_if(F.col("is_high_risk") == 1).alias("top_rows"),
        F.avg(flagged).alias("top_cancel_rate"),
        F.avg(label).alias("overall_cancel_rate"),
    )
    lift = F.try_divide("top_cancel_rate", "overall_cancel_rate")
    return rates.withColumn("lift", lift)


def segment_cancel_rate(
    df: DataFrame, segments: Sequence[str] = ("is_high_risk", *CATEGORY_COLUMNS), label: str = LABEL
) -> DataFrame:
    """Bookings and cancel rate per value of each segment column, one grouping set per column."""
    sets = [[F.col(c)] for c in segments]
    grouped = df.groupingSets(sets, *[F.col(c) for c in segments]).agg(
        F.count(F.lit(1)).alias("bookings"),
        F.avg(label).alias("cancel_rate"),
        F.grouping_id().alias("_set"),
    )
    # grouping_id has a 0 bit for the one column of the set.
    width = len(segments)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, column in enumerate(segments):
        here = F.col("_set") == (2**width - 1) - 2 ** (width - 1 - i)
        name = F.when(here, F.lit(column)).otherwise(name)
        value = F.when(here, F.col(column).cast("string")).otherwise(value)
    return grouped.select(
        name.alias("segment"), value.alias("segment_value"), "bookings", "cancel_rate"
    )


def segment_grains(
    df: DataFrame,
    segments: Sequence[str] = ("is_high_risk", *CATEGORY_COLUMNS),
    level: int = 2,
    label: str = LABEL,
) -> DataFrame:
    """Bookings and cancel rate of every combination of up to ``level`` segment columns.

    ``grain`` names the columns, joined by `` x ``; ``segment_value`` has their values joined by
    ``|``, missing ones as ``missing``. The grain of no column is the whole. All grains come from
    one pass; a task sends one row per combination that it holds.
    """
    combined = [c for n in range(level + 1) for c in combinations(segments, n)]
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in segments}
    cells = df.select(label, *[v.alias(c) for c, v in named.items()])
    sets = [[F.col(c) for c in grain] for grain in combined]
    used = [F.when(F.grouping(c) == 0, F.lit(c)) for c in segments]
    grouped = cells.groupingSets(sets, *[F.col(c) for c in segments]).agg(
        F.concat_ws(" x ", *used).alias("grain"),
        F.count(F.lit(1)).alias("bookings"),
        F.avg(label).alias("cancel_rate"),
    )
    # Columns outside a row's grain are null here, and concat_ws leaves nulls out.
    return grouped.select("grain", F.concat_ws("|", *segments).alias("segment_value"), "bookings", "cancel_rate")


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows and share per label value (null is a value of its own)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("bookings"))
    # One row per label value reaches the window.
    everything = F.sum("bookings").over(Window.partitionBy())
    return counts.select(label, "bookings", (F.col("bookings") / everything).alias("share"))


def feature_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: counts, range, mean, spread and exact quartiles.

    ``df`` is read a few times; pass a stored frame.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    measures = (
        doubles.unpivot([], list(columns), "feature", "value")
        .groupBy("feature")
        .agg(
            F.count("value").alias("present"),
            F.count_if(F.col("value").isNull()).alias("missing"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("stddev"),
        )
    )
    return measures.join(_quartiles(doubles, columns), "feature")


def _quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    quartiles = exact_quantiles(df, list(columns), [0.25, 0.5, 0.75])
    rows = [(c, *quartiles[c]) for c in columns]
    return small_frame(
        df.sparkSession, rows, "feature string, p25 double, p50 double, p75 double"
    )


def outlier_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Quartiles minus / plus ``factor`` times their distance, per column."""
    spread = F.col("p75") - F.col("p25")
    return _quartiles(df, columns).select(
        "feature",
        (F.col("p25") - factor * spread).alias("lower"),
        (F.col("p75") + factor * spread).alias("upper"),
    )


def drop_outliers(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Keep rows inside the bounds of every column; a missing value is no outlier."""
    kept = F.lit(True)
    for row in bounds.collect():  # one row per column
        value = F.col(row["feature"])
        inside = value.isNull() | value.between(row["lower"], row["upper"])
        kept = kept & inside
    return df.filter(kept)


def seasonality(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Bookings and cancel rate per reservation month and weekday."""
    return df.groupBy("reservation_month", "reservation_dayofweek").agg(
        F.count(F.lit(1)).alias("bookings"), F.avg(label).alias("cancel_rate")
    )


def calendar_check(
    dated: DataFrame,
    first: str | None = None,
    last: str | None = None,
    by: Sequence[str] = (),
    date: str = "reservation_date",
) -> DataFrame:
    """``by``, ``day, weekday, bookings, status`` for each day of a calendar and each day that has
    bookings.

    The calendar goes from ``first`` to ``last``, by default from the group's first booked day to
    its last. ``status`` is ``booked``, ``gap`` (a day of the calendar without bookings) or
    ``outside`` (bookings on a day that is not in the calendar). Weekdays count from Monday, 0.
    Rows without a date are left out, and a group that only has such rows has no days. Rows are
    counted per day before anything is joined, so what is joined is bounded by the calendar.
    """
    by = list(by)
    days = dated.filter(F.col(date).isNotNull()).groupBy(*by, F.col(date).alias("day")).agg(F.count(F.lit(1)).alias("bookings"))
    bounds = days.groupBy(*by).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    given = {n: F.lit(end).cast("date") for n, end in (("_first", first), ("_last", last)) if end}
    calendar = bounds.withColumns(given).filter("_first <= _last").select(
        *by, F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 DAY"))).alias("day"), F.lit(True).alias("_planned")
    )
    same = F.col("c.day") == F.col("d.day")
    for c in by:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"d.{c}"))
    joined = calendar.alias("c").join(days.alias("d"), same, "full_outer")
    status = F.when(F.col("d.bookings").isNull(), "gap").when(F.col("_planned"), "booked").otherwise("outside")
    day = F.coalesce("c.day", "d.day")
    keys = [F.when(F.col("_planned"), F.col(f"c.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in by]
    return joined.select(
        *keys,
        day.alias("day"),
        F.weekday(day).alias("weekday"),
        F.coalesce("d.bookings", F.lit(0).cast("long")).alias("bookings"),
        status.alias("status"),
    )


def quality_checks(df: DataFrame) -> DataFrame:
    """Raw bookings: failing rows per check.

    The schema has no arrival date; it is taken as reservation date plus lead time.
    """
    dated = parse_reservation_date(df)
    arrival = F.date_add("reservation_date", F.col("lead_time").cast("int"))
    present = F.col(DATE).isNotNull()
    checks = {
        "broken_rules": is_invalid(),
        "missing_id": F.col(ID).isNull(),
        "missing_date": ~present,
        "invalid_date": present & F.col("reservation_date").isNull(),
        "arrival_not_after_reservation": arrival <= F.col("reservation_date"),
    }
    if LABEL in df.columns:
        checks["unknown_label"] = ~F.coalesce(
            F.col(LABEL).isin("Canceled", "Not_Canceled"), F.lit(False)
        )
    counts = dated.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    duplicates = count_duplicates(df).withColumnRenamed("duplicates_count", "duplicates")
    one = F.lit(1)
    wide = counts.withColumn("_one", one).join(duplicates.withColumn("_one", one), "_one").drop("_one")
    return wide.unpivot([], wide.columns, "check_name", "failed_rows")


def client_aggregates(
    df: DataFrame,
    client: str,
    moment: str,
    canceled: Column,
    price: str,
    tie_break: Sequence[str] = (),
    most: int = GROUP_ROWS,
) -> DataFrame:
    """Per row, the client's earlier bookings, cancellations, spend and cancel ratio.

    A client-day of more than ``most`` rows is spread over tasks.
    """
    known = earlier_totals(
        df,
        key=client,
        moment=moment,
        totals={
            "earlier_bookings": F.lit(1).cast("long"),
            "earlier_cancellations": canceled.cast("long"),
            "earlier_spend": F.col(price),
        },
        tie_break=tie_break,
        most=most,
    )
    ratio = F.coalesce(F.try_divide("earlier_cancellations", "earlier_bookings"), F.lit(0.0))
    return known.withColumn("earlier_cancel_ratio", ratio)


def feature_interactions(df: DataFrame) -> DataFrame:
    """Add products and crosses of cleaned features."""
    col = F.col
    return df.withColumns(
        {
            "lead_time_x_price": col("lead_time") * col("average_price"),
            "guests_x_nights": col("total_guests") * col("total_nights"),
            "cancel_ratio_x_lead_time": col("previous_cancel_ratio") * col("lead_time"),
            "room_x_meal": F.concat_ws("|", "room_type", "type_of_meal"),
            "segment_x_month": F.concat_ws(
                "|", "market_segment_type", col("reservation_month").cast("string")
            ),
        }
    )


def _bucket(column: str, edges: list[float] | None) -> Column:
    if edges is None:
        text = F.col(column).cast("string")
        return F.coalesce(text, F.lit("missing"))
    above = F.lit(0)
    for edge in edges:
        above = above + (F.col(column) > F.lit(edge)).cast("int")
    return F.coalesce(above.cast("string"), F.lit("missing"))


def drift_buckets(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categories: Sequence[str] = (),
    buckets: int = 10,
) -> DataFrame:
    """Rows per (feature, bucket) in both frames: reference quantiles, or category values."""
    doubles = reference.select(*[F.col(c).cast("double").alias(c) for c in numeric])
    shares = [i / buckets for i in range(1, buckets)]
    edges = exact_quantiles(doubles, list(numeric), shares)
    bucket = {c: _bucket(c, [e for e in edges[c] if e is not None]) for c in numeric}
    bucket.update({c: _bucket(c, None) for c in categories})

    def histogram(df: DataFrame, name: str) -> DataFrame:
        marked = df.select(*[b.alias(c) for c, b in bucket.items()])
        return (
            marked.unpivot([], list(bucket), "feature", "bucket")
            .groupBy("feature", "bucket")
            .agg(F.count(F.lit(1)).alias(name))
        )

    both = histogram(reference, "reference_rows").join(
        histogram(current, "current_rows"), ["feature", "bucket"], "full_outer"
    )
    return both.fillna(0, ["reference_rows", "current_rows"])


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categories: Sequence[str] = (),
    buckets: int = 10,
) -> DataFrame:
    """Population stability index per feature; both frames are read a few times."""
    rows = drift_buckets(reference, current, numeric, categories, buckets)
    totals = rows.groupBy("feature").agg(
        F.sum("reference_rows").alias("_r"), F.sum("current_rows").alias("_c")
    )
    # Buckets and totals are one row per feature value / feature.
    shared = rows.join(totals, "feature")
    expected = F.greatest(F.try_divide("reference_rows", "_r"), F.lit(PSI_FLOOR))
    actual = F.greatest(F.try_divide("current_rows", "_c"), F.lit(PSI_FLOOR))
    return shared.groupBy("feature").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.sum((actual - expected) * F.log(actual / expected)).alias("psi"),
    )


def sketched_drift(reference: DataFrame, current: DataFrame, buckets: int = 10) -> DataFrame:
    """``feature, buckets, psi`` from kept sketches alone: neither frame's rows are read.

    Both hold one row per feature (see ``plans.sketches``), of which the reference's quantiles are
    collected. The buckets are those of
    :func:`feature_drift`: up to each of the reference's quantiles, above them, and missing. A
    bucket's share is off by twice ``rank_error`` at most, so the index differs from the exact one
    by a little. Features without rows on one side count as missing there. Pass kept or stored
    sketches: they are drawn with chance, and ``reference`` is read twice.
    """
    cuts = quantiles_of([i / buckets for i in range(1, buckets)])
    edges = {r["feature"]: sorted(set(r["cuts"] or [])) for r in reference.select("feature", cuts.alias("cuts")).collect()}
    old = reference.select(
        "feature", F.col("sketch").alias("_old"), F.col("rows").alias("_old_rows"), F.col("missing").alias("_old_missing")
    )
    new = current.select(
        "feature", F.col("sketch").alias("_new"), F.col("rows").alias("_new_rows"), F.col("missing").alias("_new_missing")
    )

    def bucket_shares(side: str) -> Column:
        """Shares of the buckets in order, the missing ones last."""
        rows, missing = F.coalesce(f"{side}_rows", F.lit(0)), F.coalesce(f"{side}_missing", F.lit(0))
        upto = F.array().cast("array<double>")
        for feature, values in edges.items():
            upto = F.when(F.col("feature") == feature, shares_up_to(values, side, f"{side}_rows")).otherwise(upto)
        ends = F.concat(upto, F.array(F.lit(1.0)))
        begins = F.concat(F.array(F.lit(0.0)), upto)
        known = F.coalesce(F.try_divide(rows, rows + missing), F.lit(0.0))
        inside = F.zip_with(ends, begins, lambda b, a: (b - a) * known)
        return F.concat(inside, F.array(F.coalesce(F.try_divide(missing, rows + missing), F.lit(0.0))))

    # A handful of rows: one per feature, then one per feature and bucket.
    both = old.join(new, "feature", "left").select(
        "feature", F.explode(F.arrays_zip(bucket_shares("_old").alias("old"), bucket_shares("_new").alias("new"))).alias("b")
    )
    found = both.select("feature", "b.old", "b.new").filter("old > 0 OR new > 0")
    expected, actual = (F.greatest(c, F.lit(PSI_FLOOR)) for c in (F.col("old"), F.col("new")))
    return found.groupBy("feature").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum((actual - expected) * F.log(actual / expected)).alias("psi")
    )


def assign_experiment(
    df: DataFrame, groups: Sequence[str] = ("control", "treatment"), salt: str = "pilot"
) -> DataFrame:
    """Add ``experiment_group``, fixed by the booking id and the salt.

    Bookings without id go by their content, so they spread over the groups too.
    """
    slot = F.pmod(uniform_hash(row_key(df), salt), F.lit(len(groups)))
    names = F.array(*[F.lit(g) for g in groups])
    return df.withColumn("experiment_group", F.get(names, slot.cast("int")))


def experiment_summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Size, mean probability, flagged rows and cancel rate per experiment group."""
    return df.groupBy("experiment_group").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.avg(PROBABILITY).alias("mean_probability"),
        F.count_if(F.col("is_high_risk") == 1).alias("high_risk_count"),
        F.avg(label).alias("cancel_rate"),
    )


def rule_baseline(
    history: DataFrame,
    df: DataFrame,
    segment: Sequence[str] = ("market_segment_type",),
    short_lead_days: int = 7,
) -> DataFrame:
    """The segment's historical cancel rate, and a rule flag for short lead or earlier cancellations."""
    rates = history.groupBy(*segment).agg(F.avg(LABEL).alias("historical_cancel_rate"))
    joined = lookup_join(df, rates, segment, "left")
    rule = (F.col("lead_time") < short_lead_days) | (F.col("previous_cancellations") > 0)
    return joined.withColumn("rule_flag", rule.cast("int"))


def leakage_guard(df: DataFrame) -> DataFrame:
    """Keep the id and the features known when a booking is made."""
    allowed = (ID, *FEATURE_COLUMNS)
    return df.select(*[c for c in allowed if c in df.columns])
