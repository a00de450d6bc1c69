"""Bookings derived from order tables, for running every job on real joined data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.plans.history import earlier_totals


# Canonical column -> expression over orders, customer and line counts.
_BOOKING = {
    "booking_id": (
        "explode(if(o_orderkey % 40 = 11, array('INN' || o_orderkey, 'INN' || o_orderkey || 'D'), "
        "array('INN' || o_orderkey)))"
    ),
    "number_of_adults": "int(1 + o_custkey % 3)",
    "number_of_children": "int(o_custkey % 4 % 3)",
    "number_of_weekend_nights": "int(coalesce(weekend, 0))",
    "number_of_week_nights": "int(coalesce(week, 0))",
    "type_of_meal": (
        "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL "
        "WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Meal Plan 1' "
        "WHEN o_orderpriority = '3-MEDIUM' THEN 'Meal Plan 2' ELSE 'Not Selected' END"
    ),
    "car_parking_space": "int(c_acctbal > 8000)",
    "room_type": "'Room_Type ' || (1 + c_nationkey % 7)",
    "lead_time": "int((o_orderkey * 37) % 365)",
    "market_segment_type": "c_mktsegment",
    "repeated": "int(canceled_before + kept_before > 0)",
    "previous_cancellations": "int(canceled_before)",
    "previous_not_canceled": "int(kept_before)",
    "average_price": "if(o_orderkey % 50 = 7, NULL, o_totalprice / 1000)",
    "special_requests": "int((o_orderkey * 13) % 6)",
    "date_of_reservation": (
        "CASE WHEN o_orderkey % 97 = 5 THEN '2018-2-29' WHEN o_orderkey % 89 = 3 THEN NULL "
        "WHEN o_orderkey % 2 = 0 "
        "THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) "
        "ELSE substr(string(o_orderdate), 1, 10) END"
    ),
    "booking_status": "CASE o_orderstatus WHEN 'F' THEN 'Canceled' WHEN 'O' THEN 'Not_Canceled' END",
}


def bookings_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One booking per order (some twice, as duplicates), in canonical names.

    Customer attributes and customer history are joined per (customer, day), and line items are
    counted before their join, so a customer or order holding much of the data is no hot spot.
    """
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customers = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    lines = (
        spark.read.parquet(f"{folder}/lineitem.parquet")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count_if(F.col("l_returnflag") == "R").alias("weekend"),
            F.count_if(F.col("l_returnflag") != "R").alias("week"),
        )
    )
    status = F.col("o_orderstatus")
    placed = earlier_totals(
        orders,
        key="o_custkey",
        moment="o_orderdate",
        totals={
            "canceled_before": F.when(status == "F", 1).otherwise(0),
            "kept_before": F.when(status == "O", 1).otherwise(0),
        },
        tie_break=["o_orderkey"],
        lookup=customers,
    ).join(lines, "o_orderkey", "left")

    return placed.selectExpr(*[f"{value} AS {name}" for name, value in _BOOKING.items()])


def labelled_bookings(bookings: DataFrame) -> DataFrame:
    return bookings.filter(F.col("booking_status").isNotNull())


def new_bookings(bookings: DataFrame) -> DataFrame:
    return bookings.filter(F.col("booking_status").isNull()).drop("booking_status")
