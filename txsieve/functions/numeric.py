"""Number conversions that Spark's ANSI casts would refuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2147483647
INT_MIN = -2147483648


def trunc_int(x: Column) -> Column:
    """A float as an int: cut toward zero, held within the int range, NaN as 0, NULL as NULL."""
    return (
        F.when(F.isnan(x), F.lit(0))
        .when(x >= F.lit(INT_MAX), F.lit(INT_MAX))
        .when(x <= F.lit(INT_MIN), F.lit(INT_MIN))
        .otherwise(x.try_cast("int"))
    )


def count_to_int(n: Column) -> Column:
    """A row count as an int; a missing count is 0 and one beyond the int range stays at its top."""
    return F.least(F.coalesce(n, F.lit(0)), F.lit(INT_MAX)).cast("int")
