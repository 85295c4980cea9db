import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from txsieve.schema import ENRICHED_SCHEMA, RAW_SCHEMA  # noqa: E402
from txsieve.session import build_session, new_run_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="run-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def folder(spark):
    """Names a fresh folder for each purpose."""
    return lambda purpose="data": new_run_folder(spark, purpose)


RAW_DEFAULTS = {
    "tid": 1,
    "step": 400,
    "type": "VIEW",
    "amount": 10.0,
    "nameOrig": "C1",
    "oldBalanceOrig": 5000.0,
    "newBalanceOrig": 4990.0,
    "nameDest": "M1",
    "oldBalanceDest": 100.0,
    "newBalanceDest": 110.0,
}
ENRICHED_DEFAULTS = {
    **RAW_DEFAULTS,
    "recurrence": 1,
    "destBlacklisted": 0,
    "errorBalanceOrig": 0,
    "errorBalanceDest": 0,
}


@pytest.fixture
def raw(spark):
    """A raw frame from partial rows."""
    names = RAW_SCHEMA.fieldNames()
    return lambda *rows: spark.createDataFrame(
        [tuple({**RAW_DEFAULTS, **row}[n] for n in names) for row in rows], RAW_SCHEMA
    )


@pytest.fixture
def enriched(spark):
    """An enriched frame from partial rows."""
    names = ENRICHED_SCHEMA.fieldNames()
    return lambda *rows: spark.createDataFrame(
        [tuple({**ENRICHED_DEFAULTS, **row}[n] for n in names) for row in rows], ENRICHED_SCHEMA
    )
