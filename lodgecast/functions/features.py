"""The ten derived booking features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(positive: Column) -> Column:
    return F.coalesce(positive, F.lit(False)).cast("int")


def feature_columns(date: str = "reservation_date") -> dict[str, Column]:
    """Name -> expression over canonical columns.

    Ratios divide by a count plus one. Unvalidated negative counts can make that zero; the
    ratio is then null instead of an error.
    """
    col = F.col
    nights = col("number_of_weekend_nights") + col("number_of_week_nights")
    earlier = col("previous_cancellations") + col("previous_not_canceled")
    return {
        "reservation_month": F.month(date),
        "reservation_dayofweek": F.weekday(date),
        "total_nights": nights,
        "price_per_night": F.try_divide(col("average_price"), nights + 1),
        "is_family": _flag(col("number_of_children") > 0),
        "total_guests": col("number_of_adults") + col("number_of_children"),
        "weekend_share": F.try_divide(col("number_of_weekend_nights"), nights + 1),
        "previous_bookings": earlier,
        "previous_cancel_ratio": F.try_divide(col("previous_cancellations"), earlier + 1),
        "has_special_requests": _flag(col("special_requests") > 0),
    }
