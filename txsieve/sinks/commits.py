"""Rows that say which parts of a folder are complete: written after a part, read before any."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "kind string, number long"
#: Spark's readers pass over folders with such names, so the rows can lie beside the parts.
FOLDER = "_commits"


def commit(spark: SparkSession, path: str, kind: str, number: int) -> None:
    """Say that a part is complete. A row is a file of its own, which appears whole or not at all."""
    row = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(number).cast("long").alias("number"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/{FOLDER}")


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_SCHEMA).parquet(f"{path}/{FOLDER}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest(spark: SparkSession, path: str, kind: str) -> int | None:
    """The largest complete number of a kind; None if there is none."""
    rows = _rows(spark, path)
    return None if rows is None else rows.filter(F.col("kind") == kind).agg(F.max("number")).first()[0]


def complete(spark: SparkSession, path: str, kind: str, above: int = -1) -> list[int] | None:
    """The complete numbers of a kind above one, in order; None where nothing was ever committed."""
    rows = _rows(spark, path)
    if rows is None:
        return None
    wanted = rows.filter((F.col("kind") == kind) & (F.col("number") > above)).select("number").distinct()
    return sorted(row["number"] for row in wanted.collect())


def done(spark: SparkSession, path: str, kinds: Iterable[str], number: int) -> set[str]:
    """Which of the kinds are complete for a number."""
    rows = _rows(spark, path)
    if rows is None:
        return set()
    found = rows.filter((F.col("number") == number) & F.col("kind").isin(list(kinds))).select("kind").distinct()
    return {row["kind"] for row in found.collect()}
