"""The registered queries against their SQL, and what has none against brute force elsewhere."""

from __future__ import annotations

import pytest
from compare import actual, difference, duck, expected
from conftest import SMALL

import __spark_entry__ as entry_point
from lodgecast.llm.oracles import ORACLES
from lodgecast.llm.queries import QUERIES


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_query(spark, name):
    found = actual(entry_point.queries()[name](spark, SMALL))
    assert found[1]
    if name in entry_point.oracle_sql():
        assert difference(found, expected(duck(SMALL), entry_point.oracle_sql()[name])) is None


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLES) < set(QUERIES)
