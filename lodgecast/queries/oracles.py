"""One SQL text per query, to check its result on the same tables."""

from __future__ import annotations

from itertools import combinations

from lodgecast.operators.evaluate import METRICS
from lodgecast.queries.bookings_sql import (
    NEW,
    NEW_RANKED,
    NEW_SCORED,
    NUMBERS,
    PARSED,
    STRINGS,
    TRAIN,
    TRAIN_RANKED,
    TRAIN_SCORED,
    even,
    median_of,
    mode_of,
    with_tables,
)
from lodgecast.sinks.tables import TABLES

_RATIOS = ["price_per_night", "weekend_share", "previous_cancel_ratio"]
_WIRE = {
    "booking_id": "Booking_ID",
    "number_of_adults": "number of adults",
    "number_of_children": "number of children",
    "number_of_weekend_nights": "number of weekend nights",
    "number_of_week_nights": "number of week nights",
    "type_of_meal": "type of meal",
    "car_parking_space": "car parking space",
    "room_type": "room type",
    "lead_time": "lead time",
    "market_segment_type": "market segment type",
    "repeated": "repeated",
    "previous_cancellations": "P-C",
    "previous_not_canceled": "P-not-C",
    "average_price": "average price",
    "special_requests": "special requests",
    "date_of_reservation": "date of reservation",
    "booking_status": "booking status",
}
_PROFILED = ["number_of_adults", "lead_time", "average_price", "total_nights", "price_per_night"]


def _replaced(columns: list[str], digits: int = 6) -> str:
    return "* REPLACE (" + ", ".join(f"{even(c, digits)} AS {c}" for c in columns) + ")"


def _number(text: str = "booking_id") -> str:
    return f"CAST(regexp_extract({text}, '([0-9]+)', 1) AS BIGINT)"


def _summary(source: str, filled: str, dated: str, after: str, columns: int, labelled: bool) -> str:
    content = ", ".join([*NUMBERS, *STRINGS, *(["booking_status"] if labelled else [])])
    return f"""
SELECT (SELECT count(*) FROM {source}) AS records_before,
       CAST({columns} AS INTEGER) AS columns_before,
       (SELECT count(*) FROM {after}) AS records_after,
       CAST({columns + 9} AS INTEGER) AS columns_after,
       (SELECT count(*) FROM {filled})
         - (SELECT count(*) FROM (SELECT DISTINCT {content} FROM {filled})) AS duplicates_count,
       (SELECT count(*) FROM {dated} WHERE d IS NULL) AS invalid_dates_count,
       'has_special_requests,is_family,previous_bookings,previous_cancel_ratio,price_per_night,'
         || 'reservation_dayofweek,reservation_month,total_guests,total_nights,weekend_share'
         AS added_features,
       'date_of_reservation' AS removed_features"""


_REQUESTS = f"""
CASE WHEN {_number()} % 3 = 0 THEN 0 ELSE 1 + {_number()} % 211 END"""

_PREDICTED = """
predicted AS (
  SELECT booking_status AS label, CAST(p > 0.5 AS INTEGER) AS prediction, p AS probability
  FROM train_scored),
confusion AS (
  SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
  FROM predicted),
placed AS (
  SELECT label, rank() OVER (ORDER BY probability)
                + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS place
  FROM predicted),
area AS (
  SELECT (sum(place) FILTER (WHERE label = 1)
          - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
         / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0))
         AS auc
  FROM placed)"""

_EVALUATED = f"""
evaluated AS (
  SELECT {even('(tp + tn) / (tp + fp + tn + fn)', 4)} AS accuracy,
         {even('tp / (tp + fp)', 4)} AS precision,
         {even('tp / (tp + fn)', 4)} AS recall,
         {even('2 * tp / (2 * tp + fp + fn)', 4)} AS f1,
         {even('auc', 4)} AS roc_auc
  FROM confusion, area)"""

_BATCH_METRICS = f"""
metrics AS (
  SELECT (SELECT count(*) FROM fresh) AS records_before_preprocessing,
         (SELECT count(*) FROM new_clean) AS records_after_preprocessing,
         (SELECT count(*) FROM new_dated WHERE d IS NULL) AS invalid_dates_count,
         count(*) AS predictions_count, sum(is_high_risk) AS high_risk_count,
         avg(is_high_risk) AS high_risk_share,
         avg(probability_of_cancellation) AS mean_cancellation_probability,
         max(probability_of_cancellation) AS max_cancellation_probability,
         min(probability_of_cancellation) AS min_cancellation_probability,
         avg(risk_percentile) AS avg_risk_percentile
  FROM scores)"""
_METRIC_NAMES = [
    "records_before_preprocessing", "records_after_preprocessing", "invalid_dates_count",
    "predictions_count", "high_risk_count", "high_risk_share", "mean_cancellation_probability",
    "max_cancellation_probability", "min_cancellation_probability", "avg_risk_percentile",
]


def _long(table: str, names: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS metric_name, {even(n)} AS metric_value{extra} FROM {table}" for n in names
    )


def _facts(key: str = "fact", /, **values: str) -> str:
    return _union([f"SELECT '{n}' AS {key}, CAST({v} AS DOUBLE) AS value" for n, v in values.items()])


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _split(parts: list[tuple[str, str]]) -> str:
    """Held-out quotas per class: first the kept rows by largest remainder, in turn per part."""
    steps = [
        """numbered AS (
  SELECT booking_id, booking_status, md5(booking_id || '|42') AS h,
         row_number() OVER (PARTITION BY booking_status ORDER BY md5(booking_id || '|42')) AS place
  FROM train_clean)""",
        "left0 AS (SELECT booking_status AS c, count(*) AS n, 0 AS cut FROM train_clean GROUP BY 1)",
    ]
    for i, (_, size) in enumerate(parts):
        steps.append(
            f"""exact{i} AS (
  SELECT c, n, cut, sum(n) OVER () AS total,
         (sum(n) OVER () - ceil(sum(n) OVER () * CAST({size} AS DOUBLE))) * n
           / CAST(sum(n) OVER () AS DOUBLE) AS x,
         sum(n) OVER () - ceil(sum(n) OVER () * CAST({size} AS DOUBLE)) AS kept
  FROM left{i}),
floored{i} AS (
  SELECT *, kept - sum(floor(x)) OVER () AS spare,
         row_number() OVER (ORDER BY floor(x) - x, c) AS turn FROM exact{i}),
left{i + 1} AS (
  SELECT c, floor(x) + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS n,
         cut + n - (floor(x) + CASE WHEN turn <= spare THEN 1 ELSE 0 END) AS cut
  FROM floored{i})"""
        )
    cases = " ".join(
        f"WHEN place <= (SELECT cut FROM left{i + 1} WHERE c = booking_status) THEN '{name}'"
        for i, (name, _) in enumerate(parts)
    )
    steps.append(
        f"""parted AS (
  SELECT booking_id, booking_status, CASE {cases} ELSE 'train' END AS split FROM numbered)"""
    )
    return ",\n".join(steps)


def _encode() -> str:
    cells = []
    renamed = f"type_of_meal = 'Meal Plan 1' AND {_number()} % 2 = 0"
    for column in ("type_of_meal", "room_type", "market_segment_type"):
        cells.append(
            f"CAST(coalesce((SELECT i FROM codes WHERE codes.name = '{column}' "
            f"AND codes.v = t.{column}), (SELECT count(*) FROM codes WHERE codes.name = '{column}')) "
            f"AS INTEGER) AS {column}_index"
        )
    seen = " UNION ALL ".join(
        f"SELECT '{c}' AS name, v, row_number() OVER (ORDER BY v) - 1 AS i FROM "
        f"(SELECT DISTINCT {c} AS v FROM train_clean JOIN parted USING (booking_id) WHERE split = 'train')"
        for c in ("type_of_meal", "room_type", "market_segment_type")
    )
    return (
        with_tables(TRAIN, _split([("test", "0.2")]), f"codes AS ({seen})")
        + f"SELECT booking_id, {', '.join(cells)} FROM (SELECT * REPLACE (CASE WHEN {renamed} "
        "THEN 'Meal Plan 9' ELSE type_of_meal END AS type_of_meal) FROM train_clean) t "
        "JOIN parted USING (booking_id) WHERE split = 'test'"
    )


def _encode_wide() -> str:
    """Numbers and smoothed label rates; training rows leave their own fold out."""
    parts = [
        f"""wide AS (
  SELECT t.booking_id, t.booking_status AS y, split = 'train' AS known, 'Client ' || o_custkey AS client, t.room_type,
         CAST('0x' || substr(md5(t.booking_id || '|42-fold'), 1, 13) AS BIGINT) % 5 AS fold
  FROM train_clean t JOIN parted p ON p.booking_id = t.booking_id
  JOIN orders ON o_orderkey = {_number('t.booking_id')})""",
        "totals AS (SELECT fold, count(*) AS n, sum(y) AS p FROM wide WHERE known GROUP BY fold)",
        """others AS (
  SELECT w.booking_id, (SELECT sum(n) FROM totals) - coalesce(t.n, 0) AS n, (SELECT sum(p) FROM totals) - coalesce(t.p, 0) AS p
  FROM wide w LEFT JOIN totals t ON known AND t.fold = w.fold)""",
    ]
    joins, cells = "", []
    for c in ("client", "room_type"):
        parts += [
            f"{c}_codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {c} AS v FROM wide WHERE known))",
            f"{c}_folds AS (SELECT {c} AS v, fold, count(*) AS n, sum(y) AS p FROM wide WHERE known GROUP BY 1, 2)",
            f"""{c}_sums AS (
  SELECT w.booking_id, sum(f.n) AS n, sum(f.p) AS p FROM wide w JOIN {c}_folds f ON f.v = w.{c}
  WHERE NOT known OR f.fold <> w.fold GROUP BY w.booking_id)""",
        ]
        joins += f" LEFT JOIN {c}_codes ON {c}_codes.v = w.{c} LEFT JOIN {c}_sums ON {c}_sums.booking_id = w.booking_id"
        rate = f"(coalesce({c}_sums.p, 0) + 20 * (CAST(o.p AS DOUBLE) / o.n)) / (coalesce({c}_sums.n, 0) + 20)"
        cells += [
            f"CAST(coalesce({c}_codes.i, (SELECT count(*) FROM {c}_codes)) AS INTEGER) AS {c}_index",
            f"{even(rate, 9)} AS {c}_rate",
            f"{even(f'coalesce({c}_sums.n, 0) / CAST(o.n AS DOUBLE)', 9)} AS {c}_share",
        ]
    return (
        with_tables(TRAIN, _split([("test", "0.2")]), *parts)
        + f"SELECT w.booking_id, {', '.join(cells)} FROM wide w JOIN others o ON o.booking_id = w.booking_id{joins}"
    )


def _errors(shares: bool = False) -> str:
    counts = [c for c in NUMBERS if c != "average_price"]
    checks = []
    for c in counts:
        checks.append(f"CASE WHEN {c} IS NULL THEN '{c}: Field required' END")
        checks.append(f"CASE WHEN {c} < 0 THEN '{c}: Value must be non-negative' END")
    for c in ["average_price", "type_of_meal", "room_type", "market_segment_type", "date_of_reservation"]:
        checks.append(f"CASE WHEN {c} IS NULL THEN '{c}: Field required' END")
    checks.append(
        "CASE WHEN average_price < 0 THEN 'average_price: Average price must be non-negative' END"
    )
    if shares:
        checks.append("CASE WHEN NOT (risk_share > 0 AND risk_share <= 1) THEN 'share' END")
    return f"list_filter([{', '.join(checks)}], lambda e: e IS NOT NULL)"


_SHIFTED = f"""
shifted AS (
  SELECT * REPLACE (lead_time - 9 AS lead_time, average_price - 20 AS average_price) FROM bookings),
judged AS (SELECT *, {_errors()} AS errors FROM shifted)"""

_JUDGED_REQUESTS = f"""
asked AS (
  SELECT * REPLACE (
           coalesce(type_of_meal, 'none') AS type_of_meal,
           coalesce(date_of_reservation, 'none') AS date_of_reservation,
           CASE WHEN {_number()} % 7 = 1 THEN average_price ELSE coalesce(average_price, 1.0) END
             AS average_price),
         'REQ' || ({_REQUESTS}) AS request_id,
         CASE WHEN ({_REQUESTS}) = 7 THEN 1.5
              ELSE (1 + ({_REQUESTS}) % 5) / 10.0 END AS risk_share
  FROM bookings),
judged AS (SELECT *, {_errors(shares=True)} AS errors FROM asked)"""

_SCORE_COLUMNS = (
    "booking_id, probability_of_cancellation, rank, risk_percentile, is_high_risk, risk_segment"
)


def _request_scores(source: str, number: str, share: str, prefix: str) -> str:
    """Ranking inside each request."""
    return f"""
asked AS (
  SELECT booking_id, {even('p', 4)} AS q, '{prefix}' || ({number}) AS request_id,
         CAST({share} AS DOUBLE) AS share
  FROM {source}),
in_request AS (
  SELECT *, count(*) OVER (PARTITION BY request_id) AS n,
         row_number() OVER (PARTITION BY request_id ORDER BY q DESC, booking_id) AS rank
  FROM asked),
request_scores AS (
  SELECT request_id, booking_id, q AS probability_of_cancellation, rank,
         {even('CAST(rank AS DOUBLE) / n * 100', 2)} AS risk_percentile,
         CAST(rank <= greatest(1, ceil(n * share)) AS INTEGER) AS is_high_risk,
         CASE WHEN rank <= greatest(1, ceil(n * share)) THEN 'top_30_percent' ELSE 'regular' END
           AS risk_segment
  FROM in_request)"""


_DOCUMENT_SCORES = _request_scores(
    "new_scored", f"{_number()} // 20", f"(1 + ({_number()} // 20) % 5) / 10.0", "DOC"
)

_BLOCK = f"({_number()} // 20)"
_DOCUMENT_NUMBER = "CAST(substr(request_id, 4) AS BIGINT)"
_BLOCKS = f"blocks AS (SELECT {_BLOCK} AS n, {_BLOCK} % 9 AS k, booking_id FROM fresh)"
_REJECTED = """
SELECT CASE WHEN k > 1 THEN 'DOC' || n END AS request_id, CAST(NULL AS VARCHAR) AS booking_id,
       CASE k WHEN 0 THEN 'document: Invalid JSON'
              WHEN 1 THEN 'document: Input should be an object'
              WHEN 2 THEN 'bookings: Field required'
              WHEN 3 THEN 'bookings: Input should be a valid list'
              WHEN 4 THEN 'bookings: List should have at least 1 item' END AS errors
FROM (SELECT DISTINCT n, k FROM blocks) WHERE k < 5
UNION ALL
SELECT 'DOC' || n, booking_id, CASE k WHEN 5 THEN 'risk_share must be in the range (0, 1]'
                                      ELSE 'type_of_meal: Input should be a valid string' END
FROM blocks WHERE k IN (5, 6)"""
_UNDATED = f"""
SELECT CASE WHEN {_BLOCK} % 9 = 7 THEN 'DOC' || {_BLOCK} END AS request_id, booking_id,
       'date_of_reservation: Input should be a valid date' AS errors
FROM new_dated, (VALUES (1), (2)) AS t (turn)
WHERE d IS NULL AND ({_BLOCK} % 9 = 7 OR ({_BLOCK} % 9 = 8 AND turn = 1))"""
_TURN = f"CASE WHEN {_BLOCK} % 2 = 0 THEN 'even' ELSE 'odd' END || '-' || ({_BLOCK} // 2 % 2)"
_STREAM_METRICS = f"""
metrics AS (
  SELECT * FROM
    (SELECT {_TURN} AS run_id, count(*) AS records_before_preprocessing FROM fresh GROUP BY 1)
    JOIN (SELECT {_TURN} AS run_id, count(*) FILTER (WHERE d IS NOT NULL) AS records_after_preprocessing,
                 count(*) FILTER (WHERE d IS NULL) AS invalid_dates_count
          FROM new_dated GROUP BY 1) USING (run_id)
    JOIN (SELECT {_TURN} AS run_id, count(*) AS predictions_count, sum(is_high_risk) AS high_risk_count,
                 avg(is_high_risk) AS high_risk_share,
                 avg(probability_of_cancellation) AS mean_cancellation_probability,
                 max(probability_of_cancellation) AS max_cancellation_probability,
                 min(probability_of_cancellation) AS min_cancellation_probability,
                 avg(risk_percentile) AS avg_risk_percentile
          FROM request_scores GROUP BY 1) USING (run_id))"""

_DATE_TEXT = """
texts AS (
  SELECT o_orderkey, CASE o_orderkey % 15
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
    WHEN 2 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate)
    WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
    WHEN 5 THEN strftime(o_orderdate, '%Y%m%d')
    WHEN 6 THEN year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate)
    WHEN 7 THEN strftime(o_orderdate, '%b ') || day(o_orderdate) || ', ' || year(o_orderdate)
    WHEN 8 THEN day(o_orderdate) || strftime(o_orderdate, ' %b ') || year(o_orderdate)
    WHEN 9 THEN month(o_orderdate) || '-' || day(o_orderdate) || '-' || year(o_orderdate)
    WHEN 10 THEN day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate)
    WHEN 11 THEN '2018-2-29'
    WHEN 12 THEN 'soon'
    WHEN 13 THEN '  ' || month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) || ' '
    END AS date_of_reservation
  FROM orders)"""
_DATE_FORMATS = [
    "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y%m%d",
    "%Y/%m/%d", "%b %d, %Y", "%d %b %Y", "%m-%d-%Y", "%d-%m-%Y",
]


def _quantile(column: str, share: float, table: str) -> str:
    return f"(SELECT quantile_cont(CAST({column} AS DOUBLE), {share}) FROM {table})"


def _profile() -> str:
    return _union(
        [
            f"SELECT '{c}' AS feature, count({c}) AS present, "
            f"count(*) - count({c}) AS missing, {even(f'min({c})')} AS min, "
            f"{even(f'max({c})')} AS max, {even(f'avg({c})')} AS mean, "
            f"{even(f'stddev_samp({c})')} AS stddev, "
            f"{even(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25, "
            f"{even(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50, "
            f"{even(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75 FROM train_clean"
            for c in _PROFILED
        ]
    )


def _bound(c: str, sign: str, share: float) -> str:
    return (
        f"quantile_cont(CAST({c} AS DOUBLE), {share}) {sign} 1.5 * "
        f"(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25))"
    )


def _drift() -> str:
    buckets = []
    for c in _PROFILED:
        edges = " + ".join(
            f"CAST({c} > {_quantile(c, i / 10, 'train_clean')} AS INTEGER)" for i in range(1, 10)
        )
        for which, table in (("r", "train_clean"), ("c", "new_clean")):
            buckets.append(
                f"SELECT '{c}' AS feature, '{which}' AS side, CAST({edges} AS VARCHAR) AS b FROM {table}"
            )
    for c in ("type_of_meal", "room_type", "market_segment_type"):
        for which, table in (("r", "train_clean"), ("c", "new_clean")):
            buckets.append(f"SELECT '{c}' AS feature, '{which}' AS side, {c} AS b FROM {table}")
    return (
        with_tables(
            TRAIN,
            NEW,
            f"marked AS ({_union(buckets)})",
            """counted AS (
  SELECT feature, b, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'c') AS c
  FROM marked GROUP BY feature, b),
shares AS (
  SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 0.0001) AS e,
         greatest(c / sum(c) OVER (PARTITION BY feature), 0.0001) AS a
  FROM counted)""",
        )
        + f"SELECT feature, count(*) AS buckets, {even('sum((a - e) * ln(a / e))')} AS psi "
        "FROM shares GROUP BY feature"
    )


def _segments() -> str:
    names = ["is_high_risk", "type_of_meal", "room_type", "market_segment_type"]
    return with_tables(*TRAIN_RANKED) + _union(
        [
            f"SELECT '{c}' AS segment, CAST({c} AS VARCHAR) AS segment_value, count(*) AS bookings, "
            f"{even('avg(booking_status)')} AS cancel_rate FROM train_scores GROUP BY {c}"
            for c in names
        ]
    )


def _quality() -> str:
    d = PARSED.format("date_of_reservation")
    checks = {
        "broken_rules": f"len({_errors()}) > 0",
        "missing_id": "booking_id IS NULL",
        "missing_date": "date_of_reservation IS NULL",
        "invalid_date": f"date_of_reservation IS NOT NULL AND {d} IS NULL",
        "arrival_not_after_reservation": f"{d} + lead_time <= {d}",
        "unknown_label": "coalesce(booking_status NOT IN ('Canceled', 'Not_Canceled'), TRUE)",
    }
    content = ", ".join([*NUMBERS, *STRINGS, "booking_status"])
    parts = [
        f"SELECT '{name}' AS check_name, count(*) FILTER (WHERE {test}) AS failed_rows FROM bookings"
        for name, test in checks.items()
    ]
    parts.append(
        "SELECT 'duplicates' AS check_name, count(*) - "
        f"(SELECT count(*) FROM (SELECT DISTINCT {content} FROM bookings)) AS failed_rows FROM bookings"
    )
    return with_tables() + _union(parts)


_NEW_CONTENT = ", ".join([*NUMBERS, *STRINGS, "booking_status"])
_D = PARSED.format("date_of_reservation")

_DERIVED = f"""
plain_dated AS (SELECT *, {_D} AS d FROM bookings WHERE {_D} IS NOT NULL),
derived AS (
  SELECT booking_id,
    CAST(month(d) AS INTEGER) AS reservation_month,
    CAST(isodow(d) - 1 AS INTEGER) AS reservation_dayofweek,
    number_of_weekend_nights + number_of_week_nights AS total_nights,
    {even('average_price / (number_of_weekend_nights + number_of_week_nights + 1)')}
      AS price_per_night,
    CAST(number_of_children > 0 AS INTEGER) AS is_family,
    number_of_adults + number_of_children AS total_guests,
    {even('number_of_weekend_nights / (number_of_weekend_nights + number_of_week_nights + 1)')}
      AS weekend_share,
    previous_cancellations + previous_not_canceled AS previous_bookings,
    {even('previous_cancellations / (previous_cancellations + previous_not_canceled + 1)')}
      AS previous_cancel_ratio,
    CAST(special_requests > 0 AS INTEGER) AS has_special_requests
  FROM plain_dated)"""


def _client_aggregates(orders: str) -> str:
    return (
        "SELECT o_orderkey, earlier_bookings, "
        "CAST(coalesce(earlier_cancellations, 0) AS BIGINT) AS earlier_cancellations, "
        f"{even('coalesce(earlier_spend, 0)', 2)} AS earlier_spend, "
        f"{even('coalesce(earlier_cancellations / nullif(earlier_bookings, 0), 0)')} AS earlier_cancel_ratio "
        "FROM (SELECT o_orderkey, count(*) OVER w AS earlier_bookings, "
        "sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w AS earlier_cancellations, "
        f"sum(o_totalprice) OVER w AS earlier_spend FROM {orders} WINDOW w AS (PARTITION BY o_custkey "
        "ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    )


_SQUARED = ["number_of_adults", "lead_time", "average_price", "total_nights", "price_per_night"]
_HELD_OUT = with_tables(TRAIN, _split([("test", "0.2")])) + (
    "SELECT booking_id, TRUE AS in_range, TRUE AS class_agrees FROM parted WHERE split = 'test'"
)
# The training settings and split that a report repeats.
_REPORTED = {
    "test_size": "0.2",
    "random_state": "42",
    "train_rows": "(SELECT count(*) FROM parted WHERE split = 'train')",
    "test_rows": "(SELECT count(*) FROM parted WHERE split = 'test')",
    "parameter stepSize": "0.03",
    "parameter subsamplingRate": "0.85",
    "parameter minInfoGain": "0",
}


ORACLES: dict[str, str] = {
    "bookings_view": with_tables() + "SELECT * FROM bookings",
    "rename_to_wire": with_tables()
    + "SELECT "
    + ", ".join(f'{c} AS "{w}"' for c, w in _WIRE.items())
    + " FROM bookings",
    "read_bookings_csv": with_tables()
    + "SELECT * REPLACE ("
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMBERS)
    + ") FROM bookings",
    "read_booking_requests": with_tables(NEW)
    + f"SELECT 'DOC' || ({_number()} // 20) AS request_id, "
    f"CAST((1 + ({_number()} // 20) % 5) / 10.0 AS DOUBLE) AS risk_share, * FROM fresh",
    "write_processed": with_tables(TRAIN) + f"SELECT {_replaced(_RATIOS)} FROM train_clean",
    "write_scores": with_tables(*NEW_RANKED) + "SELECT * FROM scores",
    "write_high_risk": with_tables(*NEW_RANKED) + "SELECT * FROM scores WHERE is_high_risk = 1",
    "append_predictions": with_tables(*NEW_RANKED)
    + "SELECT booking_id, probability_of_cancellation, rank, risk_percentile, "
    "CAST(is_high_risk AS BOOLEAN) AS is_high_risk, risk_segment, 'scorecard' AS model_name, run_id "
    "FROM scores, (VALUES ('run-1'), ('run-2')) AS runs (run_id)",
    "append_monitoring": with_tables(*NEW_RANKED, _BATCH_METRICS)
    + _long(
        "metrics",
        _METRIC_NAMES,
        ", 'batch_predict' AS run_type, 'scorecard' AS model_name, 'run-1' AS run_id",
    ),
    "append_model_run": with_tables(*TRAIN_SCORED, _PREDICTED, _EVALUATED)
    + "SELECT 'scorecard' AS model_name, 'v1' AS model_version, accuracy, f1, roc_auc, "
    "'{\"intercept\": -1.2}' AS parameters_json, 'run-1' AS run_id FROM evaluated",
    "scores_as_json": with_tables(*NEW_RANKED)
    + "SELECT rank, '{\"booking_id\":\"' || booking_id || '\",\"probability_of_cancellation\":' "
    "|| CAST(probability_of_cancellation AS VARCHAR) || ',\"is_high_risk\":' || is_high_risk "
    "|| ',\"risk_segment\":\"' || risk_segment || '\"}' AS record FROM scores",
    "validate_rule_counts": with_tables(_SHIFTED)
    + "SELECT rule, count(*) AS rows FROM (SELECT unnest(errors) AS rule FROM judged) GROUP BY rule",
    "validate_bookings": with_tables(_SHIFTED)
    + "SELECT booking_id FROM judged WHERE len(errors) = 0",
    "validate_rejected": with_tables(_SHIFTED)
    + "SELECT booking_id, array_to_string(errors, '; ') AS errors FROM judged WHERE len(errors) > 0",
    "validate_requests": with_tables(_JUDGED_REQUESTS)
    + "SELECT request_id, booking_id FROM judged WHERE request_id NOT IN "
    "(SELECT request_id FROM judged WHERE len(errors) > 0)",
    "validate_requests_by_row": with_tables(_JUDGED_REQUESTS)
    + "SELECT request_id, booking_id FROM judged WHERE len(errors) = 0",
    "drop_invalid_dates": with_tables()
    + f"SELECT booking_id, {_D} AS reservation_date FROM bookings WHERE {_D} IS NOT NULL",
    "filter_high_risk": with_tables(*NEW_RANKED) + "SELECT * FROM scores WHERE is_high_risk = 1",
    "select_features": with_tables(NEW)
    + f"SELECT {_replaced(_RATIOS)} FROM (SELECT * EXCLUDE (booking_id) FROM new_clean)",
    "impute_median": with_tables()
    + "SELECT booking_id, "
    + ", ".join(f"coalesce(CAST({c} AS DOUBLE), {median_of('bookings', c)}) AS {c}" for c in NUMBERS)
    + " FROM bookings",
    "impute_mode": with_tables()
    + "SELECT booking_id, "
    + ", ".join(
        f"coalesce({c}, {mode_of('bookings', c)}) AS {c}" for c in [*STRINGS, "booking_status"]
    )
    + " FROM bookings",
    "imputation_stats": with_tables(TRAIN)
    + "SELECT "
    + ", ".join(f"{median_of('labelled', c)} AS {c}" for c in NUMBERS)
    + ", "
    + ", ".join(f"{mode_of('labelled', c)} AS {c}" for c in [*STRINGS, "booking_status"]),
    "count_duplicates": with_tables()
    + f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_NEW_CONTENT} FROM bookings)) "
    "AS duplicates_count FROM bookings",
    "dedupe_bookings": with_tables()
    + f"SELECT min(booking_id) AS booking_id, {_NEW_CONTENT} FROM bookings GROUP BY {_NEW_CONTENT}",
    "encode_label": with_tables()
    + "SELECT booking_id, CASE booking_status WHEN 'Canceled' THEN 1 WHEN 'Not_Canceled' THEN 0 END "
    "AS booking_status FROM bookings",
    "parse_reservation_date": f"WITH {_DATE_TEXT} SELECT o_orderkey, date_of_reservation, "
    "CAST(coalesce("
    + ", ".join(f"try_strptime(trim(date_of_reservation), '{f}')" for f in _DATE_FORMATS)
    + ") AS DATE) AS reservation_date FROM texts",
    "count_invalid_dates": with_tables()
    + f"SELECT count(*) FILTER (WHERE {_D} IS NULL) AS invalid_dates_count FROM (SELECT "
    f"coalesce(date_of_reservation, {mode_of('bookings', 'date_of_reservation')}) "
    "AS date_of_reservation FROM bookings)",
    "preprocess_summary": with_tables(TRAIN)
    + _summary("labelled", "train_filled", "train_dated", "train_clean", 17, True),
    "preprocess_summary_scoring": with_tables(NEW)
    + _summary("fresh", "new_filled", "new_dated", "new_clean", 16, False),
    "preprocess_bookings": with_tables(TRAIN) + f"SELECT {_replaced(_RATIOS)} FROM train_clean",
    "preprocess_bookings_scoring": with_tables(NEW) + f"SELECT {_replaced(_RATIOS)} FROM new_clean",
    "preprocess_rejected": with_tables(NEW)
    + "SELECT booking_id, date_of_reservation FROM new_dated WHERE d IS NULL",
    "booking_features": with_tables(_DERIVED) + "SELECT * FROM derived",
    "reservation_dayofweek": with_tables(_DERIVED)
    + "SELECT booking_id, reservation_dayofweek FROM derived",
    "price_per_night": with_tables(_DERIVED) + "SELECT booking_id, price_per_night FROM derived",
    "previous_cancel_ratio": with_tables(_DERIVED)
    + "SELECT booking_id, previous_cancel_ratio FROM derived",
    "round_probability": with_tables(*NEW_SCORED)
    + f"SELECT booking_id, {even('p', 4)} AS probability_of_cancellation FROM new_scored",
    "rank_by_risk": with_tables(*NEW_RANKED)
    + "SELECT booking_id, probability_of_cancellation, rank, count(*) OVER () AS total_rows FROM scores",
    "risk_percentile": with_tables(*NEW_RANKED) + "SELECT booking_id, risk_percentile FROM scores",
    "high_risk_counts": with_tables()
    + "SELECT market_segment_type, bookings, share, "
    "CAST(greatest(1, ceil(bookings * share)) AS BIGINT) AS flagged FROM "
    "(SELECT market_segment_type, count(*) AS bookings FROM bookings GROUP BY 1), "
    "(SELECT CAST(s AS DOUBLE) AS share FROM (VALUES (0.0001), (0.07), (0.3), (0.34), (1.0)) AS v (s))",
    "flag_top_share": with_tables(*NEW_RANKED)
    + "SELECT booking_id, CAST(flagged AS INTEGER) AS is_high_risk, "
    "CASE WHEN flagged THEN 'top_30_percent' ELSE 'regular' END AS risk_segment FROM "
    "(SELECT booking_id, rank <= greatest(1, ceil(count(*) OVER () * CAST(0.07 AS DOUBLE))) AS flagged "
    "FROM scores)",
    "build_scoring_table": with_tables(*NEW_RANKED) + "SELECT * FROM scores",
    "assign_missing_ids": "SELECT place, l_extendedprice, row_number() OVER (ORDER BY place) "
    "AS booking_id FROM (SELECT printf('%012d-%02d-%012.2f-%08d-%08d', l_orderkey, l_linenumber, "
    "l_extendedprice, l_partkey, l_suppkey) AS place, l_extendedprice FROM lineitem)",
    "flag_by_threshold": with_tables(*NEW_SCORED)
    + f"SELECT booking_id, {even('p', 4)} AS probability_of_cancellation, "
    "CAST(p >= CAST(0.7 AS DOUBLE) AS INTEGER) AS is_high_risk, "
    "CASE WHEN p >= CAST(0.7 AS DOUBLE) THEN 'high_risk' ELSE 'regular' END AS risk_segment "
    "FROM new_scored",
    "score_requests": with_tables(
        *NEW_SCORED,
        _request_scores("new_scored", _REQUESTS, f"(1 + ({_REQUESTS}) % 5) / 10.0", "REQ"),
    )
    + "SELECT * FROM request_scores",
    "batch_result_counts": with_tables(*NEW_RANKED)
    + "SELECT count(*) AS total_bookings, CAST(sum(is_high_risk) AS BIGINT) AS high_risk_count "
    "FROM scores",
    "top_risk_preview": with_tables(*NEW_RANKED) + "SELECT * FROM scores ORDER BY rank LIMIT 5",
    "standard_output": with_tables(*NEW_RANKED)
    + "SELECT booking_id, probability_of_cancellation, rank FROM scores",
    "split_stratified": with_tables(TRAIN, _split([("test", "0.2")])) + "SELECT * FROM parted",
    "split_three_way": with_tables(TRAIN, _split([("test", "0.2"), ("validation", "0.2")]))
    + "SELECT * FROM parted",
    "encode_categories": _encode(),
    "confusion_counts": with_tables(*TRAIN_SCORED, _PREDICTED) + "SELECT * FROM confusion",
    "roc_auc": with_tables(*TRAIN_SCORED, _PREDICTED) + f"SELECT {even('auc')} AS roc_auc FROM area",
    "evaluate": with_tables(*TRAIN_SCORED, _PREDICTED, _EVALUATED) + "SELECT * FROM evaluated",
    "score_scorecard": with_tables(*NEW_SCORED)
    + f"SELECT booking_id, {even('p')} AS probability_of_cancellation FROM new_scored",
    "training_metrics": with_tables(
        *TRAIN_SCORED,
        _PREDICTED,
        _EVALUATED,
        f"""counts AS ({_summary('labelled', 'train_filled', 'train_dated', 'train_clean', 17, True)})""",
    )
    + _union(
        [
            f"SELECT '{name}' AS metric_name, CAST({column} AS DOUBLE) AS metric_value FROM {table}"
            for name, column, table in [
                ("records_before_preprocessing", "records_before", "counts"),
                ("records_after_preprocessing", "records_after", "counts"),
                ("duplicates_count", "duplicates_count", "counts"),
                ("invalid_dates_count", "invalid_dates_count", "counts"),
                *[(f"eval_{m}", m, "evaluated")
                  for m in ("accuracy", "precision", "recall", "f1", "roc_auc")],
            ]
        ]
    ),
    "batch_metrics": with_tables(*NEW_RANKED, _BATCH_METRICS) + _long("metrics", _METRIC_NAMES),
    "metrics_to_long": with_tables()
    + "SELECT 'bookings' AS metric_name, CAST(count(*) AS DOUBLE) AS metric_value FROM bookings "
    "UNION ALL SELECT 'max_lead_time', CAST(max(lead_time) AS DOUBLE) FROM bookings "
    "UNION ALL SELECT 'missing_prices', CAST(count(*) - count(average_price) AS DOUBLE) FROM bookings",
    "lift_at_share": with_tables(*TRAIN_RANKED)
    + f"SELECT CAST(sum(is_high_risk) AS BIGINT) AS top_rows, {even('t')} AS top_cancel_rate, "
    f"{even('o')} AS overall_cancel_rate, {even('t / o')} AS lift FROM (SELECT is_high_risk, "
    "avg(booking_status) FILTER (WHERE is_high_risk = 1) OVER () AS t, avg(booking_status) OVER () AS o "
    "FROM train_scores) GROUP BY t, o",
    "segment_cancel_rate": _segments(),
    "finished_runs": with_tables(*NEW_RANKED)
    + "SELECT t.table_name, r.run_id, CASE WHEN t.table_name = 'predictions' THEN (SELECT count(*) FROM scores) ELSE 10 END AS rows "
    "FROM (VALUES ('predictions'), ('monitoring_metrics')) t (table_name), (VALUES ('run-1'), ('run-3')) r (run_id)",
    "segment_grains": with_tables(*TRAIN_RANKED)
    + _union(
        [
            f"SELECT '{' x '.join(grain)}' AS grain, concat_ws('|', {', '.join([*grain, chr(39) * 2] if not grain else grain)}) "
            f"AS segment_value, count(*) AS bookings, {even('avg(booking_status)')} AS cancel_rate "
            f"FROM train_scores{' GROUP BY ' + ', '.join(grain) if grain else ''}"
            for n in range(3)
            for grain in combinations(("is_high_risk", "type_of_meal", "room_type", "market_segment_type"), n)
        ]
    ),
    "calendar_check": with_tables(
        f"days AS (SELECT market_segment_type AS s, {PARSED.format('date_of_reservation')} AS day, count(*) AS n FROM bookings GROUP BY 1, 2)",
        "calendar AS (SELECT DISTINCT s, CAST(unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '1995-12-31', "
        "INTERVAL 1 DAY)) AS DATE) AS day FROM days WHERE day IS NOT NULL)",
    )
    + "SELECT coalesce(c.s, d.s) AS market_segment_type, coalesce(c.day, d.day) AS day, "
    "CAST(isodow(coalesce(c.day, d.day)) - 1 AS INTEGER) AS weekday, coalesce(n, 0) AS bookings, "
    "CASE WHEN n IS NULL THEN 'gap' WHEN c.day IS NOT NULL THEN 'booked' ELSE 'outside' END AS status "
    "FROM calendar c FULL JOIN (SELECT * FROM days WHERE day IS NOT NULL) d ON d.s = c.s AND d.day = c.day",
    "class_balance": with_tables()
    + f"SELECT booking_status, count(*) AS bookings, "
    f"{even('count(*) / (SELECT count(*) FROM bookings)')} AS share FROM bookings GROUP BY 1",
    "feature_profile": with_tables(TRAIN) + _profile(),
    "outlier_bounds": with_tables(TRAIN)
    + _union(
        [
            f"SELECT '{c}' AS feature, {even(_bound(c, '-', 0.25))} AS lower, "
            f"{even(_bound(c, '+', 0.75))} AS upper FROM train_clean"
            for c in _PROFILED
        ]
    ),
    "drop_outliers": with_tables(TRAIN)
    + "SELECT booking_id, total_nights, lead_time FROM train_clean WHERE "
    + " AND ".join(
        f"{c} BETWEEN (SELECT {_bound(c, '-', 0.25)} FROM train_clean) "
        f"AND (SELECT {_bound(c, '+', 0.75)} FROM train_clean)"
        for c in ("total_nights", "lead_time")
    ),
    "seasonality": with_tables(TRAIN)
    + f"SELECT reservation_month, reservation_dayofweek, count(*) AS bookings, "
    f"{even('avg(booking_status)')} AS cancel_rate FROM train_clean GROUP BY 1, 2",
    "quality_checks": _quality(),
    "client_aggregates": _client_aggregates("orders"),
    "client_aggregates_hot_day": _client_aggregates(
        "(SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey, "
        "CASE WHEN o_orderkey % 3 = 0 THEN '1995-06-17' ELSE o_orderdate END AS o_orderdate) FROM orders)"
    ),
    "feature_interactions": with_tables(NEW)
    + f"SELECT booking_id, {even('lead_time * average_price')} AS lead_time_x_price, "
    "total_guests * total_nights AS guests_x_nights, "
    f"{even('previous_cancel_ratio * lead_time')} AS cancel_ratio_x_lead_time, "
    "room_type || '|' || type_of_meal AS room_x_meal, "
    "market_segment_type || '|' || reservation_month AS segment_x_month FROM new_clean",
    "feature_drift": _drift(),
    "assign_experiment": with_tables()
    + "SELECT booking_id, CASE WHEN CAST('0x' || substr(md5(booking_id || '|pilot'), 1, 13) AS BIGINT) "
    "% 2 = 0 THEN 'control' ELSE 'treatment' END AS experiment_group FROM bookings",
    "experiment_summary": with_tables(*TRAIN_RANKED)
    + "SELECT CASE WHEN CAST('0x' || substr(md5(booking_id || '|pilot'), 1, 13) AS BIGINT) % 2 = 0 "
    "THEN 'control' ELSE 'treatment' END AS experiment_group, count(*) AS bookings, "
    f"{even('avg(probability_of_cancellation)')} AS mean_probability, "
    f"CAST(sum(is_high_risk) AS BIGINT) AS high_risk_count, {even('avg(booking_status)')} AS cancel_rate "
    "FROM train_scores GROUP BY 1",
    "rule_baseline": with_tables(TRAIN, NEW)
    + f"SELECT booking_id, {even('r')} AS historical_cancel_rate, "
    "CAST(lead_time < 7 OR previous_cancellations > 0 AS INTEGER) AS rule_flag FROM new_clean LEFT JOIN "
    "(SELECT market_segment_type, avg(booking_status) AS r FROM train_clean GROUP BY 1) "
    "USING (market_segment_type)",
    "leakage_guard": with_tables(TRAIN)
    + f"SELECT {_replaced(_RATIOS)} FROM (SELECT * EXCLUDE (booking_status) FROM train_clean)",
    "stream_score_single": with_tables(*NEW_SCORED)
    + f"SELECT booking_id, {even('p', 4)} AS probability_of_cancellation, "
    "CAST(p >= CAST(0.7 AS DOUBLE) AS INTEGER) AS is_high_risk, "
    "CASE WHEN p >= CAST(0.7 AS DOUBLE) THEN 'high_risk' ELSE 'regular' END AS risk_segment "
    "FROM new_scored",
    "stream_score_requests": with_tables(*NEW_SCORED, _DOCUMENT_SCORES)
    + "SELECT * FROM request_scores",
    "stream_batch_metrics": with_tables(*NEW_SCORED, _DOCUMENT_SCORES, _STREAM_METRICS)
    + _long("metrics", _METRIC_NAMES, ", 'stream_predict' AS run_type, run_id"),
    "read_booking_requests_rejected": with_tables(NEW, _BLOCKS) + _REJECTED,
    "score_equal_payloads": with_tables(*NEW_SCORED, _DOCUMENT_SCORES)
    + "SELECT request_scores.* FROM request_scores, (VALUES (1), (2)) AS t (turn) "
    f"WHERE {_DOCUMENT_NUMBER} % 9 = 7",
    "stream_rejected": with_tables(NEW, _BLOCKS) + f"{_REJECTED} UNION ALL {_UNDATED}",
    "append_monitoring_types": with_tables(*NEW_RANKED, _BATCH_METRICS)
    + "SELECT * FROM ("
    + _long("metrics", _METRIC_NAMES, ", 'run-1' AS run_id")
    + "), (VALUES ('train', 'scorecard'), ('batch_predict', 'scorecard'), ('train', 'other')) "
    "AS t (run_type, model_name)",
    "parse_reservation_date_shapes": "SELECT o_orderkey, CASE WHEN o_orderkey % 16 <> 12 THEN make_date("
    "CASE WHEN o_orderkey % 16 < 13 THEN year(o_orderdate) WHEN o_orderkey % 3 = 0 THEN 2068 "
    "WHEN o_orderkey % 3 = 1 THEN 1969 ELSE 1999 END, month(o_orderdate), least(day(o_orderdate), 28)) "
    "END AS reservation_date FROM orders",
    "ensure_run_tables": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{name}', '{column}', '{kind}', {10 if name == 'monitoring_metrics' else 0})"
        for name, columns in TABLES.items()
        for column, kind in (c.split() for c in columns.split(", "))
    )
    + ") AS t (table_name, column_name, kind, rows)",
    "training_job": with_tables(
        TRAIN,
        _split([("test", "0.2")]),
        f"""counts AS ({_summary('labelled', 'train_filled', 'train_dated', 'train_clean', 17, True)})""",
    )
    + _facts(
        model_runs="1",
        train_rows="(SELECT count(*) FROM parted WHERE split = 'train')",
        test_rows="(SELECT count(*) FROM parted WHERE split = 'test')",
        categories="3",
        report_parts="6",
        named="1",
        statistics=str(len(NUMBERS) + len(STRINGS) + 1),
        changed_scores="0",
        records_before_preprocessing="(SELECT records_before FROM counts)",
        records_after_preprocessing="(SELECT records_after FROM counts)",
        duplicates_count="(SELECT duplicates_count FROM counts)",
        invalid_dates_count="(SELECT invalid_dates_count FROM counts)",
    ),
    "batch_job": with_tables(NEW)
    + _facts(
        **{n: "(SELECT count(*) FROM new_clean)" for n in ("scores", "ranks", "last_rank", "probabilities", "predictions")},
        **{n: "(SELECT ceil(count(*) * CAST(0.3 AS DOUBLE)) FROM new_clean)" for n in ("flagged", "high_risk_file")},
        first_is_flagged="1",
        train_metrics="9",
        batch_metrics="10",
    ),
    "model_contracts": with_tables(TRAIN, _split([("test", "0.2")]))
    + _facts(
        **{
            n: "(SELECT count(*) FROM parted WHERE split = 'test')"
            for n in ("baseline_rows", "baseline_in_range", "baseline_classes", "rule_rows")
        },
        rule_names="0",
        models="3",
        best_models="1",
        metrics_in_range="3",
        settings="2",
        best_settings="1",
    ),
    "predict_proba": _HELD_OUT,
    "train_baseline_lr": _HELD_OUT,
    "train_and_report": with_tables(TRAIN, _split([("test", "0.2")]))
    + _facts("name", **{m: "1" for m in METRICS}, **_REPORTED),
    "score_batch": with_tables(*NEW_RANKED)
    + "SELECT rank, risk_percentile, is_high_risk, risk_segment, TRUE AS ordered FROM scores",
    "score_single_rule": with_tables(NEW)
    + "SELECT booking_id, TRUE AS in_range, TRUE AS follows_rule, TRUE AS named FROM new_clean",
    # Contracts of any fit: the candidates and settings that were asked for.
    "compare_models": "SELECT unnest(['GBT', 'LogisticRegression', 'RandomForest']) AS model, "
    "TRUE AS metrics_in_range, TRUE AS best_by_area",
    "cross_validate": "SELECT unnest(['{\"maxDepth\": 4}', '{\"maxDepth\": 8}']) AS settings, "
    "TRUE AS score_in_range, TRUE AS has_trees, TRUE AS best_was_fitted",
    "encode_wide_categories": _encode_wide(),
    "sketched_drift": with_tables(TRAIN)
    + _union(
        [
            f"SELECT '{c}' AS feature, count({c}) AS rows, count(*) - count({c}) AS missing, "
            "TRUE AS ranks_within_bound, TRUE AS near_exact FROM train_clean"
            for c in _SQUARED
        ]
    ),
    "stream_feature_drift": with_tables(NEW)
    + _union(
        [
            f"SELECT '{c}' AS feature, count({c}) AS rows, TRUE AS no_index_below_zero, TRUE AS all_kept FROM new_clean"
            for c in _SQUARED
        ]
    ),
}
