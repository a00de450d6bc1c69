"""Registered queries against their SQL. Set ALL_QUERIES=1 to run every one."""

from __future__ import annotations

import os

import pytest
from compare import actual, difference, duck, expected
from conftest import SMALL

import __spark_entry__ as entry_point
from lodgecast.queries import bound

CHOSEN = [
    "bookings_view", "read_bookings_csv", "validate_rejected", "validate_requests",
    "parse_reservation_date", "preprocess_bookings", "preprocess_summary_scoring",
    "build_scoring_table", "score_requests", "split_three_way", "evaluate", "batch_metrics",
    "segment_cancel_rate", "feature_drift", "client_aggregates", "append_predictions",
    "stream_score_requests", "score_equal_payloads", "stream_rejected",
    "parse_reservation_date_shapes", "training_job",
]
NAMES = list(entry_point.queries()) if os.environ.get("ALL_QUERIES") else CHOSEN


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, connection, name):
    found = actual(entry_point.queries()[name](spark, SMALL))
    assert found[1]
    if name in entry_point.oracle_sql():
        assert difference(found, expected(connection, entry_point.oracle_sql()[name])) is None


def test_stream_feature_drift_makes_its_bookings_once(spark, monkeypatch):
    made = []
    from_orders = bound.O.bookings_from_orders
    monkeypatch.setattr(bound.O, "bookings_from_orders", lambda *a: made.append(a) or from_orders(*a))
    assert bound.stream_feature_drift(spark, SMALL).filter("all_kept").count() == 5
    assert len(made) == 1


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0
