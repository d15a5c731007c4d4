"""Every query against its SQL, and every other query for rows and a stable schema."""

import oracle
import pytest

import __spark_entry__ as entry
from sitegauge.plans.everything import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, duck, name):
    assert oracle.compare(QUERIES[name](spark, data), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
