"""Streams of messages into Kafka topics or files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from txsieve.config import JobConfig
from txsieve.functions.messages import encode_messages
from txsieve.sinks.tables import write_batch


def kafka_write_options(config: JobConfig, topic: str) -> dict[str, str]:
    config.require("kafka_servers")
    return {"kafka.bootstrap.servers": config.kafka_servers, "topic": topic}


@dataclass(frozen=True)
class KafkaTopic:
    """A topic to write to. A repeated batch sends its messages again."""

    config: JobConfig
    topic: str

    def attach(self, messages: DataFrame) -> DataStreamWriter:
        options = kafka_write_options(self.config, self.topic)
        return messages.select("key", "value").writeStream.format("kafka").options(**options)

    def write_records(self, records: DataFrame, batch_id: int) -> None:
        options = kafka_write_options(self.config, self.topic)
        encode_messages(records, keep_nulls=True).write.format("kafka").options(**options).save()


@dataclass(frozen=True)
class MessageFolder:
    """A folder of message files: Parquet with key and value, or text with the values alone."""

    path: str
    fmt: str = "parquet"

    def _columns(self) -> list[str]:
        return ["value"] if self.fmt == "text" else ["key", "value"]

    def attach(self, messages: DataFrame) -> DataStreamWriter:
        return messages.select(*self._columns()).writeStream.format(self.fmt).option("path", self.path)

    def write_records(self, records: DataFrame, batch_id: int) -> None:
        messages = encode_messages(records, keep_nulls=True).select(*self._columns())
        write_batch(messages, batch_id, self.path, self.fmt)


@dataclass(frozen=True)
class RecordTable:
    """A Parquet table that takes the records of each batch as columns."""

    path: str

    def write_records(self, records: DataFrame, batch_id: int) -> None:
        write_batch(records, batch_id, self.path)
