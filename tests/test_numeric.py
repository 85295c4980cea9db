import math

import pytest
from pyspark.sql import functions as F

from txsieve.functions.numeric import INT_MAX, INT_MIN, count_to_int, trunc_int

CASES = [
    (1.7, 1),
    (-1.7, -1),
    (0.999, 0),
    (3e10, INT_MAX),
    (-3e10, INT_MIN),
    (math.inf, INT_MAX),
    (-math.inf, INT_MIN),
    (math.nan, 0),
    (2147483520.0, 2147483520),
    (None, None),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_trunc_int(spark, kind):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], f"i int, x {kind}")
    got = {r["i"]: r["y"] for r in df.select("i", trunc_int(F.col("x")).alias("y")).collect()}
    assert got == {i: y for i, (_, y) in enumerate(CASES)}


def test_count_to_int(spark):
    df = spark.createDataFrame([(None,), (0,), (7,), (3 * 10**11,)], "n long")
    assert [r[0] for r in df.select(count_to_int(F.col("n"))).collect()] == [0, 0, 7, INT_MAX]
