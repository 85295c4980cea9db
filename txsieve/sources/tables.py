"""Tables of transactions, history, blacklist and labels: Parquet folders or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from txsieve.config import JobConfig


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table; the schema is given, so no file is opened to find it out."""
    return spark.read.schema(schema).parquet(path)


def jdbc_options(config: JobConfig, table: str) -> dict[str, str]:
    config.require("jdbc_url", "jdbc_driver")
    options = {
        "url": config.jdbc_url,
        "driver": config.jdbc_driver,
        "dbtable": table,
        "user": config.jdbc_user,
        "password": config.jdbc_password,
    }
    return {key: value for key, value in options.items() if value}


def jdbc_read_options(
    config: JobConfig,
    table: str,
    partition_column: str | None = None,
    lower: int = 0,
    upper: int = 0,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a table scan, split on ranges of a number column when one is named."""
    options = {**jdbc_options(config, table), "fetchsize": str(fetch_size)}
    if partition_column:
        if lower >= upper or partitions < 2:
            raise ValueError("a split scan needs lower < upper and at least two partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, config: JobConfig, table: str, **split) -> DataFrame:
    """A database table; ``split`` as in :func:`jdbc_read_options`."""
    return spark.read.format("jdbc").options(**jdbc_read_options(config, table, **split)).load()
