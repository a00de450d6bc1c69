"""Cleaning: values worked out by hand and the awkward frames."""

from __future__ import annotations

import datetime
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodgecast.functions.dates import with_date
from lodgecast.operators import analysis as A
from lodgecast.operators import clean as C
from lodgecast.operators.validate import (
    drop_invalid_dates,
    rule_counts,
    select_features,
    validate_bookings,
    validate_requests,
)
from lodgecast.schemas import DATE, DERIVED_COLUMNS, LABEL


def features(df):
    return C.preprocess_bookings(df, is_training=False).frame


def test_features_of_the_two_samples(spark, bookings):
    first = features(bookings({})).first().asDict()
    assert [first[c] for c in DERIVED_COLUMNS] == [4, 4, 4.0, 120.5 / 5, 1, 3.0, 0.2, 1.0, 0.0, 1]
    second = features(bookings({}, base=1)).first().asDict()
    assert [second[c] for c in DERIVED_COLUMNS] == [
        10, 3, 5.0, 220 / 6, 0, 2.0, 2 / 6, 2.0, 2 / 3, 0,
    ]


def test_labelled_row_has_26_columns(bookings):
    cleaned = C.preprocess_bookings(bookings({}, labelled=True), is_training=True)
    assert cleaned.frame.count() == 1 and len(cleaned.frame.columns) == 26
    assert cleaned.frame.columns[-1] == "booking_id" and DATE not in cleaned.frame.columns
    assert len(select_features(cleaned.frame).columns) == 24
    summary = cleaned.summary.first()
    assert (summary["columns_before"], summary["columns_after"]) == (17, 26)
    assert summary["removed_features"] == [DATE]
    assert summary["added_features"] == sorted(DERIVED_COLUMNS)


def test_no_rows(bookings):
    cleaned = C.preprocess_bookings(bookings(labelled=True), is_training=True)
    assert cleaned.frame.count() == 0
    summary = cleaned.summary.first()
    assert summary["records_before"] == summary["duplicates_count"] == 0


def test_median_takes_the_middle_of_two_and_skips_nan(bookings):
    df = bookings(*[{"booking_id": str(i), "average_price": p} for i, p in enumerate([1.0, 4.0, None, float("nan"), 2.0, 9.0])])
    filled = C.impute_median(df, ["average_price"])
    assert sorted(r[0] for r in filled.select("average_price").collect()) == [1, 2, 3, 3, 4, 9]


def test_integer_gaps_get_a_fractional_median(bookings):
    df = bookings(*[{"lead_time": v} for v in (1, 2, None)])
    assert sorted(r["lead_time"] for r in C.impute(df).collect()) == [1.0, 1.5, 2.0]


def test_mode_ties_take_the_smallest_and_empty_columns_stay_empty(bookings):
    df = bookings(
        *[{"type_of_meal": m, "room_type": None} for m in ("b", "a", "b", "a", "c", None)]
    )
    filled = C.impute_mode(df, ["type_of_meal", "room_type"])
    assert sorted(r["type_of_meal"] for r in filled.collect()) == ["a", "a", "a", "b", "b", "c"]
    assert {r["room_type"] for r in filled.collect()} == {None}


def test_stored_statistics_are_used_as_given(bookings):
    stats = C.imputation_stats(bookings({"average_price": 10.0}, {"average_price": 30.0}))
    filled = C.impute(bookings({"average_price": None, "room_type": None}), stats)
    assert filled.first()["average_price"] == 20.0
    assert filled.first()["room_type"] == "Room_Type 1"


def test_approximate_statistics(bookings):
    df = bookings(*[{"average_price": float(p)} for p in range(1, 12)])
    assert C.imputation_stats(df, approx=True).first()["average_price"] == 6.0


def test_missing_dates_are_filled_but_unreadable_ones_drop(bookings):
    df = bookings(
        {"booking_id": "a", DATE: "5/6/2018"},
        {"booking_id": "b", DATE: "5/6/2018"},
        {"booking_id": "c", DATE: None},
        {"booking_id": "d", DATE: "2018-2-29"},
    )
    cleaned = C.preprocess_bookings(df, is_training=False)
    assert rows(cleaned.frame, "booking_id") == [("a",), ("b",), ("c",)]
    assert rows(cleaned.rejected, "booking_id") == [("d",)]
    summary = cleaned.summary.first()
    assert (summary["records_before"], summary["records_after"]) == (4, 3)
    assert (summary["duplicates_count"], summary["invalid_dates_count"]) == (2, 1)


def test_training_drops_duplicates_and_scoring_keeps_them(bookings):
    same = [{"booking_id": i} for i in ("n3", "n1", "n2")]
    assert rows(C.preprocess_bookings(bookings(*same, labelled=True)).frame, "booking_id") == [("n1",)]
    assert features(bookings(*same)).count() == 3
    assert C.count_duplicates(bookings(*same)).first()[0] == 2


def test_same_date_in_two_formats_is_no_duplicate(bookings):
    df = bookings({DATE: "2018-05-06"}, {DATE: "5/6/2018"})
    assert C.count_duplicates(df).first()[0] == 0


def test_rows_with_missing_cells_can_be_duplicates(bookings):
    df = bookings({"average_price": None}, {"average_price": None})
    assert C.count_duplicates(df).first()[0] == 1


def test_input_position_decides_which_duplicate_stays(bookings):
    df = bookings({"booking_id": "z"}, {"booking_id": "a"})
    placed = df.withColumn("input_position", F.when(F.col("booking_id") == "z", 1).otherwise(2))
    assert rows(C.dedupe_bookings(placed), "booking_id", "input_position") == [("z", 1)]


def test_labels(bookings):
    df = bookings(*[{LABEL: v} for v in ("Canceled", "Not_Canceled", "canceled", None)], labelled=True)
    assert sorted((r[LABEL] for r in C.encode_label(df).collect()), key=repr) == [0, 1, None, None]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("10/2/2015", (2015, 10, 2)), ("13/5/2018", (2018, 5, 13)), ("2018-2-29", None),
        ("2026-04-10", (2026, 4, 10)), (" 2018-1-2 ", (2018, 1, 2)), ("20180210", (2018, 2, 10)),
        ("2018/3/4", (2018, 3, 4)), ("Feb 9, 2018", (2018, 2, 9)), ("9 Feb 2018", (2018, 2, 9)),
        ("2-9-2018", (2018, 2, 9)), ("25-9-2018", (2018, 9, 25)), ("2/9/18", (2018, 2, 9)),
        ("2018-02-09 10:11:12", (2018, 2, 9)), ("2018-02-09T10:11:12", (2018, 2, 9)),
        ("soon", None), ("", None), (None, None), ("13/13/2018", None),
    ],
)
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], f"{DATE} string")
    found = C.parse_reservation_date(df).first()["reservation_date"]
    assert found == (datetime.date(*expected) if expected else None)


def test_zero_denominators_give_null(bookings):
    df = bookings({"number_of_week_nights": -2, "previous_cancellations": -2})
    row = features(df).first()
    assert row["price_per_night"] is None and row["weekend_share"] is None
    assert row["previous_cancel_ratio"] is None


def test_rules(bookings):
    df = bookings(
        {"booking_id": "ok"}, {"booking_id": None, "lead_time": -1},
        {"booking_id": "x", "average_price": -0.5, "room_type": None},
    )
    valid, rejected = validate_bookings(df)
    assert rows(valid, "booking_id") == [("ok",)]
    assert {r["booking_id"]: r["errors"] for r in rejected.collect()} == {
        None: ["lead_time: Value must be non-negative"],
        "x": ["room_type: Field required", "average_price: Average price must be non-negative"],
    }
    assert rule_counts(df).count() == 3


def test_one_bad_booking_rejects_its_request(bookings):
    df = bookings(
        {"booking_id": "a"}, {"booking_id": "b", "lead_time": -1}, {"booking_id": "c"},
        {"booking_id": "d"}, {"booking_id": "e"},
    ).withColumns(
        {
            "request_id": F.when(F.col("booking_id").isin("a", "b"), "r1").otherwise(F.col("booking_id")),
            "risk_share": F.when(F.col("booking_id") == "d", 1.5)
            .when(F.col("booking_id") == "e", 0.0).otherwise(1.0),
        }
    )
    valid, rejected = validate_requests(df)
    assert rows(valid, "booking_id") == [("c",)]
    assert {r["booking_id"]: len(r["errors"]) for r in rejected.collect()} == {
        "a": 0, "b": 1, "d": 1, "e": 1,
    }
    assert rows(validate_requests(df, "quarantine_row")[0], "booking_id") == [("a",), ("c",)]
    with pytest.raises(ValueError):
        validate_requests(df, "ignore")


def test_many_rejected_requests_are_not_built_on_the_driver(spark, bookings, monkeypatch):
    from lodgecast.plans import joins

    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", 50, 4, None))
    df = bookings({"booking_id": "a"}).drop("booking_id", "lead_time").crossJoin(
        spark.range(400).select(
            F.col("id").cast("string").alias("booking_id"),
            (F.col("id") % 200).cast("string").alias("request_id"),
            F.lit(0.5).alias("risk_share"),
            F.when(F.col("id") < 150, -1).otherwise(3).alias("lead_time"),
        )
    )
    valid, rejected = validate_requests(df)
    assert valid.count() == 100 and rejected.count() == 300
    for frame in (valid, rejected):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


DATES = [  # text, date
    ("1/5/99", "1999-01-05"), ("1/5/69", "1969-01-05"), ("1/5/68", "2068-01-05"), ("13/5/18", "2018-05-13"),
    ("2/29/00", "2000-02-29"), ("06-Jan-18", "2018-01-06"), ("10-Apr-2026", "2026-04-10"),
    ("2026-04-10 10:00", "2026-04-10"), ("2026-04-10T10:00", "2026-04-10"),
    ("2026-04-10 10:00:00.000", "2026-04-10"), ("2026-4-1T23:59:59", "2026-04-01"),
    ("5/6/2018 10:00", "2018-05-06"), ("10 April 2026", "2026-04-10"), ("April 10, 2026", "2026-04-10"),
    ("Apr 10 2026", "2026-04-10"), ("Apr 10, 2026", "2026-04-10"), ("May 5 2026", "2026-05-05"),
    ("10.04.2026", "2026-10-04"), ("13.04.2026", "2026-04-13"), ("2026.04.10", "2026-04-10"),
    ("20260410", "2026-04-10"), (" 10/2/2015 ", "2015-10-02"),
    ("2026-04-10 25:00", None), ("2026-04-10 10:61", None), ("2018-2-29", None), ("soon", None), ("", None),
    (None, None), ("10:00", None), ("31-Feb-18", None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, date_of_reservation string")
    found = C.parse_reservation_date(df).orderBy("i").collect()
    read = [str(r["reservation_date"]) if r["reservation_date"] else None for r in found]
    assert read == [d for _, d in DATES]


@pytest.mark.parametrize(
    "text, day",
    [
        ("29-Feb-72", (1972, 2, 29)), ("2/29/1900", None), ("june 5, 2020", (2020, 6, 5)),
        ("MAY 5 2020", (2020, 5, 5)), ("Sept 5 2020", None), ("5-June-2020", None), ("5 June 2020", (2020, 6, 5)),
        ("13/12/2020", (2020, 12, 13)), ("12/13/2020", (2020, 12, 13)), ("13/13/2020", None), ("1.2.68", None),
        ("1-2-68", (2068, 1, 2)), ("1/2/69", (1969, 1, 2)), ("2020-1/2", None), ("2020/01/02T10:00", (2020, 1, 2)),
        ("20200230", None), ("20200229 24:00", None), (" 2020.2.9 ", (2020, 2, 9)), ("", None), (None, None),
        ("4/0/2020", None), ("0/4/2020", None), ("5 2020 June", None),
    ],
)
def test_date_shapes(spark, text, day):
    found = with_date(spark.createDataFrame([(text,)], "d string"), "d", "found").first()["found"]
    assert found == (day and datetime.date(*day))


def test_the_date_chain_is_small_enough_to_compile(spark, bookings, tmp_path):
    """The longest chain of the library in one stage: no method is too large for the JIT (8,000
    bytes), and the date is read in one place. See also conftest."""
    bookings({}).write.parquet(str(tmp_path / "b"))
    read = spark.read.parquet(str(tmp_path / "b"))
    dated = C.booking_features(drop_invalid_dates(C.parse_reservation_date(read)))
    query = dated._jdf.queryExecution()
    assert query.optimizedPlan().toString().count("^\\d{8}$") == 1
    debug = getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$")
    code = getattr(debug, "MODULE$").codegenString(query.executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) == 1 and sizes[0] < 8_000


def test_calendar_has_gaps_and_days_outside(spark):
    days = ["2024-02-27", "2024-02-27", "2024-03-01", None, "2024-03-05"]
    df = spark.createDataFrame([("a", d) for d in days] + [(None, "2024-02-28"), ("z", None)], "s string, d string")
    df = df.withColumn("reservation_date", F.col("d").cast("date"))
    found = {
        (r["s"], r["day"].isoformat()): (r["weekday"], r["bookings"], r["status"])
        for r in A.calendar_check(df, "2024-02-28", "2024-03-02", ["s"]).collect()
    }
    assert found == {
        ("a", "2024-02-27"): (1, 2, "outside"), ("a", "2024-02-28"): (2, 0, "gap"), ("a", "2024-02-29"): (3, 0, "gap"),
        ("a", "2024-03-01"): (4, 1, "booked"), ("a", "2024-03-02"): (5, 0, "gap"), ("a", "2024-03-05"): (1, 1, "outside"),
        (None, "2024-02-28"): (2, 1, "booked"), (None, "2024-02-29"): (3, 0, "gap"), (None, "2024-03-01"): (4, 0, "gap"),
        (None, "2024-03-02"): (5, 0, "gap"),
    }
    own = A.calendar_check(df).collect()
    assert len(own) == 8 and sum(r["bookings"] for r in own) == 5 and {r["status"] for r in own} == {"booked", "gap"}
    assert A.calendar_check(df.limit(0)).count() == 0
    assert A.calendar_check(df.limit(0), "2024-01-01", "2024-01-31").filter("status = 'gap'").count() == 31


def test_grains_of_segments(spark):
    df = spark.createDataFrame(
        [("x", "p", 1), ("x", "q", 0), ("y", None, 1), ("y", "p", None)], f"a string, b string, {LABEL} int"
    )
    found = {(r["grain"], r["segment_value"]): (r["bookings"], r["cancel_rate"]) for r in A.segment_grains(df, ["a", "b"]).collect()}
    assert found == {
        ("", ""): (4, 2 / 3), ("a", "x"): (2, 0.5), ("a", "y"): (2, 1.0), ("b", "p"): (2, 1.0), ("b", "q"): (1, 0.0),
        ("b", "missing"): (1, 1.0), ("a x b", "x|p"): (1, 1.0), ("a x b", "x|q"): (1, 0.0),
        ("a x b", "y|missing"): (1, 1.0), ("a x b", "y|p"): (1, None),
    }
    assert {r["grain"] for r in A.segment_grains(df, ["a", "b"], level=1).collect()} == {"", "a", "b"}
