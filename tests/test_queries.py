"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from compare import duckdb_rows, spark_rows
from txsieve.plans.oracles import ORACLES
from txsieve.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# How many live transactions and rule detections the smallest tables hold.
LIVE, DETECTED = 480, 116


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert spark_rows(driver.queries()[name](spark, SF_DIR)) == duckdb_rows(SF_DIR, driver.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_scores_cover_every_transaction(spark, name):
    columns, rows = spark_rows(driver.queries()[name](spark, SF_DIR))
    assert columns == ["isFraud", "tid"]
    assert sum(rows.values()) == len(rows) == LIVE


def test_entry(spark):
    assert driver.entry(spark).count() == DETECTED


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
