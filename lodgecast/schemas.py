"""Column names, types and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Wire (file / JSON) name -> canonical column name.
WIRE_TO_CANONICAL = {
    "Booking_ID": "booking_id",
    "number of adults": "number_of_adults",
    "number of children": "number_of_children",
    "number of weekend nights": "number_of_weekend_nights",
    "number of week nights": "number_of_week_nights",
    "type of meal": "type_of_meal",
    "car parking space": "car_parking_space",
    "room type": "room_type",
    "lead time": "lead_time",
    "market segment type": "market_segment_type",
    "repeated": "repeated",
    "P-C": "previous_cancellations",
    "P-not-C": "previous_not_canceled",
    "average price": "average_price",
    "special requests": "special_requests",
    "date of reservation": "date_of_reservation",
    "booking status": "booking_status",
}
CANONICAL_TO_WIRE = {canonical: wire for wire, canonical in WIRE_TO_CANONICAL.items()}

ID, LABEL, DATE = "booking_id", "booking_status", "date_of_reservation"
POSITION = "input_position"  # optional; stands for the order of the input rows

COUNT_COLUMNS = [
    "number_of_adults",
    "number_of_children",
    "number_of_weekend_nights",
    "number_of_week_nights",
    "car_parking_space",
    "lead_time",
    "repeated",
    "previous_cancellations",
    "previous_not_canceled",
    "special_requests",
]
PRICE = "average_price"
NUMERIC_COLUMNS = [*COUNT_COLUMNS, PRICE]
CATEGORY_COLUMNS = ["type_of_meal", "room_type", "market_segment_type"]
# The raw date and the label are strings while missing cells are being filled.
STRING_COLUMNS = [*CATEGORY_COLUMNS, DATE, LABEL]

DERIVED_COLUMNS = [
    "reservation_month",
    "reservation_dayofweek",
    "total_nights",
    "price_per_night",
    "is_family",
    "total_guests",
    "weekend_share",
    "previous_bookings",
    "previous_cancel_ratio",
    "has_special_requests",
]
FEATURE_COLUMNS = [*NUMERIC_COLUMNS, *CATEGORY_COLUMNS, *DERIVED_COLUMNS]

SCORE_COLUMNS = [
    "booking_id",
    "probability_of_cancellation",
    "rank",
    "risk_percentile",
    "is_high_risk",
    "risk_segment",
]

# Cells a CSV reader of the pandas family treats as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Tunables.
HIGH_RISK_THRESHOLD = 0.7
RISK_SHARE = 0.3
TEST_SIZE = 0.2
SEED = 42

# Segment labels. The top-share label does not depend on the share.
SEGMENT_TOP, SEGMENT_HIGH, SEGMENT_REGULAR = "top_30_percent", "high_risk", "regular"


def booking_schema(labelled: bool = True) -> T.StructType:
    """Canonical booking row."""
    fields = []
    for name in WIRE_TO_CANONICAL.values():
        if name == LABEL and not labelled:
            continue
        if name in COUNT_COLUMNS:
            kind: T.DataType = T.IntegerType()
        elif name == PRICE:
            kind = T.DoubleType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def wire_text_schema(labelled: bool) -> T.StructType:
    """Every wire column as text, in file order; used for raw CSV."""
    return T.StructType(
        [
            T.StructField(wire, T.StringType())
            for wire, name in WIRE_TO_CANONICAL.items()
            if labelled or name != LABEL
        ]
    )
