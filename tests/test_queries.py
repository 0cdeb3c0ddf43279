"""Every query of the catalogue against DuckDB."""

import pytest
from oracle import SF, connect, differences

from veridoc import queries as catalogue

NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def duck():
    return connect()


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    assert differences(df, catalogue.oracle_sql()[name], duck) == ([], [])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first()["n_total"] == 1000
