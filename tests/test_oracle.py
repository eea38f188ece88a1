"""Every plan with SQL gives the same rows and types as DuckDB on whole tables."""

import pytest

import __spark_entry__ as driver
import compare

SF_DIR = "/root/testdata/sf0.001"
PLANS, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_equals_sql(spark, con, name):
    df = PLANS[name](spark, SF_DIR)
    assert not compare.type_differences(df, con, SQL[name])
    columns, rows = compare.spark_rows(df)
    sql_columns, sql_rows = compare.sql_rows(con, SQL[name])
    assert columns == sql_columns
    assert len(rows) == len(sql_rows)
    assert rows == sql_rows, compare.first_differences(rows, sql_rows)


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_plan_without_sql_runs(spark, name):
    assert PLANS[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_plan():
    assert set(SQL) <= set(PLANS)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["op_type", "keys", "total_value", "last_change"]
    assert df.count() > 0
