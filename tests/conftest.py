from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodgecast.session import clear_scratch, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # A plan whose generated code does not compile fails here, where Spark would go on more slowly.
    session = local_session(8, 4, **{"spark.sql.codegen.fallback": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


# Two sample bookings in wire names.
SAMPLES = [
    {
        "Booking_ID": "INN00001", "number of adults": 2, "number of children": 1,
        "number of weekend nights": 1, "number of week nights": 3, "type of meal": "Meal Plan 1",
        "car parking space": 0, "room type": "Room_Type 1", "lead time": 45,
        "market segment type": "Online", "repeated": 0, "P-C": 0, "P-not-C": 1,
        "average price": 120.5, "special requests": 2, "date of reservation": "2026-04-10",
    },
    {
        "Booking_ID": "INN00099", "number of adults": 2, "number of children": 0,
        "number of weekend nights": 2, "number of week nights": 3, "type of meal": "Meal Plan 1",
        "car parking space": 0, "room type": "Room_Type 1", "lead time": 180,
        "market segment type": "Online", "repeated": 0, "P-C": 2, "P-not-C": 0,
        "average price": 220.0, "special requests": 0, "date of reservation": "2026-10-01",
    },
]


@pytest.fixture()
def bookings(spark):
    """Makes a canonical frame of booking rows: the first sample with changes."""
    from lodgecast.schemas import WIRE_TO_CANONICAL, booking_schema

    def make(*changes: dict, labelled: bool = False, base: int = 0):
        rows = []
        for change in changes:
            row = {WIRE_TO_CANONICAL[k]: v for k, v in SAMPLES[base].items()}
            row["booking_status"] = "Canceled"
            row.update(change)
            rows.append(row)
        schema = booking_schema(labelled)
        return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)

    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
