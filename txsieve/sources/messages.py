"""Messages (string key, string value) from Kafka topics and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from txsieve.config import JobConfig
from txsieve.schema import MESSAGE_SCHEMA

# A replay from the start comes in batches of this size instead of as one.
MESSAGES_PER_TRIGGER = 100_000_000
FILES_PER_TRIGGER = 1_000
# Spark's file streams pass over files that are older than this against the newest one; none is too old here.
NEVER_TOO_OLD = "36500d"


def kafka_read_options(
    config: JobConfig,
    topic: str,
    starting: str = "earliest",
    max_per_trigger: int = MESSAGES_PER_TRIGGER,
) -> dict[str, str]:
    config.require("kafka_servers")
    return {
        "kafka.bootstrap.servers": config.kafka_servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": str(config.fail_on_data_loss).lower(),
        "maxOffsetsPerTrigger": str(max_per_trigger),
    }


def read_kafka(spark: SparkSession, config: JobConfig, topic: str, **options) -> DataFrame:
    """A topic as a stream; ``options`` as in :func:`kafka_read_options`. Needs Spark's Kafka package."""
    stream = spark.readStream.format("kafka").options(**kafka_read_options(config, topic, **options)).load()
    return _as_messages(stream)


def _as_messages(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _reader(
    spark: SparkSession, stream: bool, files_per_trigger: int
) -> DataFrameReader | DataStreamReader:
    if not stream:
        return spark.read
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", NEVER_TOO_OLD)


def read_json_lines(
    spark: SparkSession, folder: str, stream: bool = False, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Each line of the text files in ``folder`` as a message without a key."""
    lines = _reader(spark, stream, files_per_trigger).text(folder)
    return lines.select(F.lit(None).cast("string").alias("key"), "value")


def read_message_table(
    spark: SparkSession, folder: str, stream: bool = False, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Messages kept as a Parquet folder."""
    reader = _reader(spark, stream, files_per_trigger)
    return reader.schema(MESSAGE_SCHEMA).parquet(folder).select("key", "value")
