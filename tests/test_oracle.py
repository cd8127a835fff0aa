"""Every checked query against its SQL oracle, on the smallest tables."""

import os
import sys

import pytest

from conftest import ROOT, SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, SMALL).toPandas()
    if name in entry.oracle_sql():
        assert check.compare(result, duck.execute(entry.oracle_sql()[name]).df()) == "ok"
    else:
        assert len(result) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
