"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    ok, msg = compare(sdf.toPandas(), con.execute(ORACLES[name]).df())
    assert ok, f"{name}: {msg}"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "ip", "range_id", "city", "state", "size", "error"]
    assert df.count() == 1000


def test_every_query_has_callable():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 40
