"""Rounding, risk rules and the fixed scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.schemas import HIGH_RISK_THRESHOLD, ID, SEED, SEGMENT_HIGH, SEGMENT_REGULAR, SEGMENT_TOP

# Coefficients of the scorecard, a logistic model over cleaned bookings.
SCORECARD_INTERCEPT = -1.2
SCORECARD = {
    "lead_time": 0.006,
    "previous_cancel_ratio": 1.5,
    "special_requests": -0.35,
    "average_price": 0.002,
    "repeated": -0.8,
}


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the even neighbour, scale back: array-library rounding of doubles."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def high_risk_count(rows: Column, share: Column | float) -> Column:
    """At least one row; the product is taken in doubles, so 100 x 0.07 gives 8."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.greatest(F.lit(1).cast("long"), F.ceil(rows * share.cast("double")).cast("long"))


def percentile_of(rank: Column, rows: Column) -> Column:
    return round_half_even(rank / rows * 100, 2)


def top_share_segment(flag: Column) -> Column:
    return F.when(flag == 1, SEGMENT_TOP).otherwise(SEGMENT_REGULAR)


def exceeds(probability: Column, threshold: float = HIGH_RISK_THRESHOLD) -> Column:
    """1 when the unrounded probability reaches the threshold."""
    return (probability >= F.lit(float(threshold))).cast("int")


def threshold_segment(flag: Column) -> Column:
    return F.when(flag == 1, SEGMENT_HIGH).otherwise(SEGMENT_REGULAR)


def scorecard_probability() -> Column:
    z = F.lit(SCORECARD_INTERCEPT)
    for name, weight in SCORECARD.items():
        z = z + F.lit(weight) * F.col(name)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def uniform_hash(key: Column, salt: str | int = SEED) -> Column:
    """A repeatable number in [0, 2**52): the first 13 hex digits of md5(key|salt)."""
    digest = F.md5(F.concat_ws("|", key, F.lit(str(salt))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def row_key(df: DataFrame) -> Column:
    """What identifies a booking: its id, or its content where there is none."""
    content = F.to_json(F.struct(*[c for c in df.columns if c != ID]))
    return F.coalesce(F.col(ID).cast("string"), content) if ID in df.columns else content
