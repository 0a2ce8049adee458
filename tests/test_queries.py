"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

import compare
from tidemark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    found, columns, _ = compare.spark_rows(QUERIES[name](spark, SF))
    wanted, wanted_columns, _ = compare.sql_rows(ORACLES[name], SF)
    assert columns == wanted_columns
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"gbt_walkforward", "logistic_walkforward"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["year", "n", "positives", "rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
