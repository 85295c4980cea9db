"""Counts per pair of accounts as a table of which a batch reads only the parts that its pairs lie in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.operators.enrich import PAIR, pair_counts
from txsieve.sinks import commits

#: Parts a table is laid out in unless its first counts say otherwise; a part's rows should fill a file or a few.
PARTS = 256
_SCHEMA = "nameOrig string, nameDest string, pairCount long, part int"
_MERGED = "merged"
_ADDED = "added"


def part_of(parts: int) -> Column:
    """The part of a pair, by the first bits of a hash of its accounts."""
    return F.pmod(F.xxhash64(*PAIR), F.lit(parts)).cast("int")


def start_pair_counts(history: DataFrame, path: str, parts: int = PARTS) -> None:
    """Count past transactions into a new table, or over an old one's rows. ``parts`` stays with the table."""
    spark = history.sparkSession
    spark.range(1).select(F.lit(parts).alias("parts")).coalesce(1).write.mode("overwrite").parquet(path)
    _write(pair_counts(history), f"{path}/_{_MERGED}-0", parts)
    commits.commit(spark, path, _MERGED, 0)


def add_pair_counts(transactions: DataFrame, path: str) -> int:
    """Add later transactions' counts as one more layer and give its number. A layer counts once its row is written; none is ever changed."""
    spark = transactions.sparkSession
    number = max(commits.latest(spark, path, _ADDED) or 0, commits.latest(spark, path, _MERGED) or 0) + 1
    _write(pair_counts(transactions), f"{path}/_{_ADDED}-{number}", _parts(spark, path))
    commits.commit(spark, path, _ADDED, number)
    return number


def merge_pair_counts(spark: SparkSession, path: str) -> int:
    """Sum the layers into one, beside readers and before any layer that comes meanwhile, and give the last number in it."""
    last = max(commits.latest(spark, path, _ADDED) or 0, commits.latest(spark, path, _MERGED) or 0)
    if commits.latest(spark, path, _MERGED) != last:
        whole = read_pair_counts(spark, path).groupBy(*PAIR).agg(F.sum("pairCount").alias("pairCount"))
        _write(whole, f"{path}/_{_MERGED}-{last}", _parts(spark, path))
        commits.commit(spark, path, _MERGED, last)
    return last


def read_pair_counts(spark: SparkSession, path: str, batch: DataFrame | None = None) -> DataFrame:
    """(nameOrig, nameDest, pairCount) of all layers, for :func:`~txsieve.operators.enrich.add_recurrence`, which adds them up.

    With a ``batch`` of transactions only the parts that its pairs lie in are read: their numbers, as many as the table has parts at most, are
    looked up first and become a partition filter. A batch with pairs in every part reads every part.
    """
    merged = commits.latest(spark, path, _MERGED)
    added = commits.complete(spark, path, _ADDED, merged) or []
    folders = [f"{path}/_{_MERGED}-{merged}", *[f"{path}/_{_ADDED}-{number}" for number in added]]
    layers = [spark.read.schema(_SCHEMA).parquet(folder) for folder in folders]
    if batch is not None:
        needed = batch.select(part_of(_parts(spark, path)).alias("part")).distinct().collect()
        layers = [layer.filter(F.col("part").isin([row["part"] for row in needed])) for layer in layers]
    return reduce(DataFrame.unionByName, layers).drop("part")


def _parts(spark: SparkSession, path: str) -> int:
    return spark.read.schema("parts int").parquet(path).first()["parts"]


def _write(counts: DataFrame, folder: str, parts: int) -> None:
    laid = counts.withColumn("part", part_of(parts)).repartition("part").sortWithinPartitions(*PAIR)
    laid.write.partitionBy("part").mode("overwrite").parquet(folder)
