"""Every registered query with an oracle gives the oracle's rows; the others run."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import connect, difference, type_difference

SF = "/root/testdata/sf0.01"
SLOW = {"cross_validate", "sweep", "select_features"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"Renewal_Year", "auto_renewal_off", "n", "churn_pct"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    relation = con.sql(oracle_sql()[name])
    assert type_difference(df, relation) is None
    assert difference(df, relation.df()) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_rows_only(spark, name):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0
