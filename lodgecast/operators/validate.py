"""Row rules for bookings and scoring requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.plans.joins import lookup_join
from lodgecast.plans.storage import stored
from lodgecast.schemas import CATEGORY_COLUMNS, COUNT_COLUMNS, DATE, PRICE

# Rejection messages.
NEGATIVE_COUNT = "Value must be non-negative"
NEGATIVE_PRICE = "Average price must be non-negative"
BAD_SHARE = "risk_share must be in the range (0, 1]"
MISSING = "Field required"

TYPE_ERRORS = "type_errors"  # messages about cells of the wrong type, where the source finds any

_REQUIRED = [*COUNT_COLUMNS, PRICE, *CATEGORY_COLUMNS, DATE]


def _checks(df: DataFrame | None = None) -> list[tuple[Column, str]]:
    """(broken, message) per rule. Only the id may be missing."""
    checks = []
    if df is not None and "request_id" in df.columns and "document_id" not in df.columns:
        checks.append((F.col("request_id").isNull(), f"request_id: {MISSING}"))
    for name in _REQUIRED:
        checks.append((F.col(name).isNull(), f"{name}: {MISSING}"))
        if name in COUNT_COLUMNS:
            checks.append((F.col(name) < 0, f"{name}: {NEGATIVE_COUNT}"))
    checks.append((F.col(PRICE) < 0, f"{PRICE}: {NEGATIVE_PRICE}"))
    return checks


def _share_check() -> tuple[Column, str]:
    share = F.col("risk_share")
    return F.coalesce(~((share > 0) & (share <= 1)), F.lit(True)), BAD_SHARE


def _any(checks: list[tuple[Column, str]], df: DataFrame | None = None) -> Column:
    """One boolean in generated code; messages are only put together for broken rows."""
    typed = df is not None and TYPE_ERRORS in df.columns
    broken = F.size(TYPE_ERRORS) > 0 if typed else F.lit(False)
    for test, _ in checks:
        broken = broken | F.coalesce(test, F.lit(False))
    return broken


def _messages(checks: list[tuple[Column, str]], df: DataFrame | None = None) -> Column:
    found = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in checks]))
    if df is None or TYPE_ERRORS not in df.columns:
        return found
    # A cell of the wrong type is also missing; the type is what to report.
    names = F.transform(TYPE_ERRORS, lambda e: F.concat(F.split_part(e, F.lit(":"), F.lit(1)), F.lit(f": {MISSING}")))
    return F.concat(TYPE_ERRORS, F.array_except(found, names))


def is_invalid() -> Column:
    """Whether a booking breaks any rule."""
    return _any(_checks())


def validate_bookings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows keep an ``errors`` array of ``column: message``."""
    checks = _checks()
    broken = _any(checks, df)
    rejected = df.filter(broken).withColumn("errors", _messages(checks, df))
    return df.filter(~broken), rejected


def rule_counts(df: DataFrame) -> DataFrame:
    """Number of rows breaking each rule."""
    checks = _checks()
    return (
        df.filter(_any(checks))
        .select(F.explode(_messages(checks)).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def validate_requests(
    df: DataFrame, on_invalid: str = "reject_request"
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) over exploded requests; rejected rows keep their ``errors``.

    ``reject_request``: one bad booking, or a share outside (0, 1], rejects the whole request.
    ``quarantine_row``: only the bad rows go. A bad share still rejects every row.

    A request is one ``document_id`` if the column is there, else one ``request_id``, and then a
    row without id is broken by itself. The rows are written once; ids of bad requests are
    combined before their shuffle and joined back by broadcast while few, salted beyond that, so
    a request of any size is no hot spot.
    """
    checks = [*_checks(df), _share_check()]
    broken = _any(checks, df)
    if on_invalid == "quarantine_row":
        rejected = df.filter(broken).withColumn("errors", _messages(checks, df))
        return df.filter(~broken), rejected
    if on_invalid != "reject_request":
        raise ValueError("on_invalid must be 'reject_request' or 'quarantine_row'")
    request = "document_id" if "document_id" in df.columns else "request_id"
    rows = stored(df, "requests-to-check")
    bad = rows.filter(broken & F.col(request).isNotNull()).select(request).distinct()
    marked = lookup_join(rows, bad.withColumn("_bad", F.lit(True)), [request], "left")
    valid = marked.filter(F.col("_bad").isNull() & ~broken)
    rejected = marked.filter(F.col("_bad") | broken).withColumn("errors", _messages(checks, df))
    return valid.select(*df.columns), rejected.select(*df.columns, "errors")


def drop_invalid_dates(df: DataFrame, date: str = "reservation_date") -> DataFrame:
    return df.filter(F.col(date).isNotNull())


def select_features(df: DataFrame) -> DataFrame:
    """Drop the id and the label where present."""
    return df.drop("booking_id", "booking_status")
