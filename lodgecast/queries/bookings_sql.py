"""Shared SQL: the derived bookings and their cleaning, written independently of the jobs."""

from __future__ import annotations

NUMBERS = [
    "number_of_adults", "number_of_children", "number_of_weekend_nights", "number_of_week_nights",
    "car_parking_space", "lead_time", "repeated", "previous_cancellations",
    "previous_not_canceled", "average_price", "special_requests",
]
STRINGS = ["type_of_meal", "room_type", "market_segment_type", "date_of_reservation"]

BOOKINGS = """
lines AS (
  SELECT l_orderkey,
         count(*) FILTER (WHERE l_returnflag = 'R') AS weekend,
         count(*) FILTER (WHERE l_returnflag <> 'R') AS week
  FROM lineitem GROUP BY l_orderkey),
known AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
         coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER earlier, 0) AS f_before,
         coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER earlier, 0) AS o_before
  FROM orders
  WINDOW earlier AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
single AS (
  SELECT k,
    'INN' || k AS booking_id,
    CAST(1 + o_custkey % 3 AS INTEGER) AS number_of_adults,
    CAST(o_custkey % 4 % 3 AS INTEGER) AS number_of_children,
    CAST(coalesce(weekend, 0) AS INTEGER) AS number_of_weekend_nights,
    CAST(coalesce(week, 0) AS INTEGER) AS number_of_week_nights,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
         WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Meal Plan 1'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'Meal Plan 2'
         ELSE 'Not Selected' END AS type_of_meal,
    CAST(c_acctbal > 8000 AS INTEGER) AS car_parking_space,
    'Room_Type ' || (1 + c_nationkey % 7) AS room_type,
    CAST((k * 37) % 365 AS INTEGER) AS lead_time,
    c_mktsegment AS market_segment_type,
    CAST(f_before + o_before > 0 AS INTEGER) AS repeated,
    CAST(f_before AS INTEGER) AS previous_cancellations,
    CAST(o_before AS INTEGER) AS previous_not_canceled,
    CASE WHEN k % 50 = 7 THEN NULL ELSE o_totalprice / 1000 END AS average_price,
    CAST((k * 13) % 6 AS INTEGER) AS special_requests,
    CASE WHEN k % 97 = 5 THEN '2018-2-29'
         WHEN k % 89 = 3 THEN NULL
         WHEN k % 2 = 0 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
         ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS date_of_reservation,
    CASE o_orderstatus WHEN 'F' THEN 'Canceled' WHEN 'O' THEN 'Not_Canceled' END AS booking_status
  FROM known JOIN customer ON c_custkey = o_custkey LEFT JOIN lines ON l_orderkey = k),
bookings AS (
  SELECT * EXCLUDE (k) FROM single
  UNION ALL
  SELECT * REPLACE (booking_id || 'D' AS booking_id) FROM (
    SELECT * EXCLUDE (k) FROM single WHERE k % 40 = 11))"""

PARSED = (
    "CAST(coalesce(try_strptime(trim({0}), '%Y-%m-%d'), try_strptime(trim({0}), '%m/%d/%Y'), "
    "try_strptime(trim({0}), '%d/%m/%Y')) AS DATE)"
)


def even(value: str, digits: int = 6) -> str:
    """Round half to even, in doubles."""
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"round_even(CAST({value} AS DOUBLE) * {scale}, 0) / {scale}"


def mode_of(table: str, column: str) -> str:
    return (
        f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


def median_of(table: str, column: str) -> str:
    return f"(SELECT median(CAST({column} AS DOUBLE)) FROM {table})"


def filled(table: str, strings: list[str]) -> str:
    """Columns of ``table`` with missing cells filled from the table itself."""
    cells = ["booking_id"]
    cells += [f"coalesce(CAST({c} AS DOUBLE), {median_of(table, c)}) AS {c}" for c in NUMBERS]
    cells += [f"coalesce({c}, {mode_of(table, c)}) AS {c}" for c in strings]
    return f"SELECT {', '.join(cells)} FROM {table}"


FEATURES = """
    CAST(month(d) AS INTEGER) AS reservation_month,
    CAST(isodow(d) - 1 AS INTEGER) AS reservation_dayofweek,
    number_of_weekend_nights + number_of_week_nights AS total_nights,
    average_price / (number_of_weekend_nights + number_of_week_nights + 1) AS price_per_night,
    CAST(coalesce(number_of_children > 0, FALSE) AS INTEGER) AS is_family,
    number_of_adults + number_of_children AS total_guests,
    number_of_weekend_nights / (number_of_weekend_nights + number_of_week_nights + 1) AS weekend_share,
    previous_cancellations + previous_not_canceled AS previous_bookings,
    previous_cancellations / (previous_cancellations + previous_not_canceled + 1)
      AS previous_cancel_ratio,
    CAST(coalesce(special_requests > 0, FALSE) AS INTEGER) AS has_special_requests"""

_CONTENT = ", ".join([*NUMBERS, *STRINGS])

TRAIN = f"""
labelled AS (SELECT * FROM bookings WHERE booking_status IS NOT NULL),
train_filled AS ({filled('labelled', [*STRINGS, 'booking_status'])}),
train_unique AS (
  SELECT min(booking_id) AS booking_id, {_CONTENT}, booking_status
  FROM train_filled GROUP BY {_CONTENT}, booking_status),
train_dated AS (
  SELECT * REPLACE (CASE booking_status WHEN 'Canceled' THEN 1 WHEN 'Not_Canceled' THEN 0 END
                    AS booking_status),
         {PARSED.format('date_of_reservation')} AS d
  FROM train_unique),
train_clean AS (
  SELECT * EXCLUDE (d, date_of_reservation), {FEATURES}
  FROM train_dated WHERE d IS NOT NULL)"""

NEW = f"""
fresh AS (SELECT * EXCLUDE (booking_status) FROM bookings WHERE booking_status IS NULL),
new_filled AS ({filled('fresh', STRINGS)}),
new_dated AS (SELECT *, {PARSED.format('date_of_reservation')} AS d FROM new_filled),
new_clean AS (
  SELECT * EXCLUDE (d, date_of_reservation), {FEATURES}
  FROM new_dated WHERE d IS NOT NULL)"""

_Z = (
    "-1.2 + 0.006 * lead_time + 1.5 * previous_cancel_ratio - 0.35 * special_requests "
    "+ 0.002 * average_price - 0.8 * repeated"
)


def scored(table: str, name: str) -> str:
    return f"{name} AS (SELECT *, 1 / (1 + exp(-({_Z}))) AS p FROM {table})"


def ranked(table: str, name: str, share: str = "CAST(0.3 AS DOUBLE)", keep: str = "") -> str:
    """Score table of ``table`` (booking_id, p), best first."""
    return f"""
{name}_order AS (
  SELECT booking_id, {even('p', 4)} AS probability_of_cancellation{keep},
         count(*) OVER () AS n,
         row_number() OVER (ORDER BY {even('p', 4)} DESC, booking_id) AS rank
  FROM {table}),
{name} AS (
  SELECT booking_id, probability_of_cancellation, rank,
         {even('CAST(rank AS DOUBLE) / n * 100', 2)} AS risk_percentile,
         CAST(rank <= greatest(1, ceil(n * {share})) AS INTEGER) AS is_high_risk,
         CASE WHEN rank <= greatest(1, ceil(n * {share})) THEN 'top_30_percent' ELSE 'regular' END
           AS risk_segment{keep}
  FROM {name}_order)"""


def with_tables(*parts: str) -> str:
    return "WITH " + ",".join([BOOKINGS, *parts]) + "\n"


NEW_SCORED = [NEW, scored("new_clean", "new_scored")]
NEW_RANKED = [*NEW_SCORED, ranked("new_scored", "scores")]
TRAIN_SCORED = [TRAIN, scored("train_clean", "train_scored")]
TRAIN_RANKED = [
    *TRAIN_SCORED,
    ranked(
        "train_scored",
        "train_scores",
        keep=", booking_status, type_of_meal, room_type, market_segment_type",
    ),
]
