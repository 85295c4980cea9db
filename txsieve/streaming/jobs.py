"""Streaming jobs: enrichment, detection by rules and by model, and keeping the detections."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from txsieve.functions.messages import (
    decode_messages,
    encode_messages,
    parse_messages,
    quarantined_messages,
    records,
)
from txsieve.operators import model as scoring
from txsieve.operators import rules as screening
from txsieve.operators.enrich import enrich
from txsieve.operators.rules import RuleSet
from txsieve.schema import DETECTION_SCHEMA, ENRICHED_SCHEMA, RAW_SCHEMA
from txsieve.sinks import commits
from txsieve.sinks.tables import upsert_detections

# Reads a lookup table anew, so that each batch sees its latest rows.
LoadTable = Callable[[], DataFrame]
# Takes the records of one batch and its number.
WriteBatch = Callable[[DataFrame, int], None]


class MessageSink(Protocol):
    def attach(self, messages: DataFrame) -> DataStreamWriter: ...


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_messages(
    messages: DataFrame, sink: MessageSink, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Send a stream of messages to a topic or folder. Each job needs a checkpoint of its own."""
    return _start(sink.attach(messages), checkpoint, available_now)


def start_quarantine(
    messages: DataFrame, schema: StructType, sink: MessageSink, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Send the messages that do not fit ``schema`` to a topic or folder of their own, as they came.

    It stands beside a job that reads the same messages with ``strict=False``: each message goes to one of them.
    """
    return start_messages(quarantined_messages(messages, schema), sink, checkpoint, available_now)


def start_enrichment(
    messages: DataFrame,
    history: LoadTable | None,
    blacklist: LoadTable,
    outputs: list[WriteBatch],
    checkpoint: str,
    quarantine: WriteBatch | None = None,
    available_now: bool = False,
    counts_for: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Decode raw messages, enrich them and hand each batch to every output.

    With several outputs, such as a topic, a rule detector and a model, the batch is enriched once. An output
    that has taken a batch is marked beside the checkpoint, and doesn't get it again when another one fails and the batch is
    repeated; only a job that ends between an output and its mark gives that output its batch twice. ``history`` may load past transactions or,
    better for a large history, a table of their pair counts; ``counts_for`` stands for it and is given the batch, so that
    :func:`~txsieve.sinks.pair_counts.read_pair_counts` reads only the batch's parts. Invalid messages go to
    ``quarantine``; without one they fail the job.
    """

    marks = checkpoint.rstrip("/") + "-outputs"
    names = [f"output-{place}" for place in range(len(outputs))] + ["quarantine"] * bool(quarantine)
    started = False

    def process(batch: DataFrame, batch_id: int) -> None:
        nonlocal started
        # A batch is repeated only by a restarted job, as the first it gets.
        taken = set() if started else commits.done(batch.sparkSession, marks, names, batch_id)
        started = True
        parsed = parse_messages(batch, RAW_SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
        # Counting fills the cache, from which Spark then knows how large the batch is.
        parsed.count()
        valid = records(parsed, RAW_SCHEMA, fill_missing=True, strict=quarantine is None)
        past = counts_for(valid) if counts_for else history()
        enriched = enrich(valid, past, blacklist(), few=True)
        writes = list(zip(names, outputs))
        if len(writes) > 1:
            enriched = enriched.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name, write in writes:
                if name not in taken:
                    write(enriched, batch_id)
                    if len(names) > 1:
                        commits.commit(batch.sparkSession, marks, name, batch_id)
            if quarantine and "quarantine" not in taken:
                quarantine(parsed.filter("not valid").select("key", "value"), batch_id)
        finally:
            enriched.unpersist()
            parsed.unpersist()

    return _start(messages.writeStream.foreachBatch(process), checkpoint, available_now)


def enriched_messages(
    messages: DataFrame, history: DataFrame, blacklist: DataFrame, strict: bool = True
) -> DataFrame:
    """Raw messages as a stream of enriched ones, for :func:`start_messages`.

    Into a :class:`~txsieve.sinks.messages.MessageFolder` each message comes exactly once, also where a batch is repeated: Spark's file
    sink writes a list of a batch's files after them, and readers of the folder, live streams too, follow that list. The lookups are
    those of the job's start; :func:`start_enrichment` reads them anew for each batch.
    """
    raw = decode_messages(messages, RAW_SCHEMA, fill_missing=True, strict=strict)
    return encode_messages(enrich(raw, history, blacklist), keep_nulls=True)


def start_model_versions(
    messages: DataFrame, models: str, write: WriteBatch, checkpoint: str, available_now: bool = False, strict: bool = True
) -> StreamingQuery:
    """Score enriched messages with the latest model that :func:`~txsieve.operators.model.publish` has completed in a folder.

    Each batch looks for a newer one before it is scored, so a model takes over without a restart. The batch written has ``(tid,
    isFraud, modelVersion)``; verdicts of earlier batches keep their model's.
    """
    enriched = decode_messages(messages, ENRICHED_SCHEMA, strict=strict)
    loaded: dict[int, PipelineModel] = {}

    def process(batch: DataFrame, batch_id: int) -> None:
        version = scoring.latest_version(batch.sparkSession, models)
        if version is None:
            raise ValueError(f"{models} holds no complete model")
        if version not in loaded:
            loaded.clear()
            loaded[version] = scoring.load(scoring.version_path(models, version))
        write(scoring.score(loaded[version], batch).withColumn("modelVersion", F.lit(version)), batch_id)

    return _start(enriched.writeStream.foreachBatch(process), checkpoint, available_now)


def rule_output(rules: RuleSet, write: WriteBatch) -> WriteBatch:
    """An output of :func:`start_enrichment` that writes the rule set's detections."""
    return lambda batch, batch_id: write(screening.detections(batch, rules), batch_id)


def model_output(model: PipelineModel, write: WriteBatch) -> WriteBatch:
    """An output of :func:`start_enrichment` that writes the model's verdicts."""
    return lambda batch, batch_id: write(scoring.score(model, batch), batch_id)


# The message jobs fail on an invalid message, unless ``strict`` is off and :func:`start_quarantine` takes it.


def rule_messages(messages: DataFrame, rules: RuleSet, strict: bool = True) -> DataFrame:
    """Messages with the rule set's detections among enriched messages."""
    enriched = decode_messages(messages, ENRICHED_SCHEMA, strict=strict)
    return encode_messages(screening.detections(enriched, rules))


def clean_rule_messages(messages: DataFrame, rules: RuleSet, strict: bool = True) -> DataFrame:
    """Messages with the transactions the rule set leaves."""
    enriched = decode_messages(messages, ENRICHED_SCHEMA, strict=strict)
    return encode_messages(screening.undetected(enriched, rules))


def model_messages(messages: DataFrame, model: PipelineModel, strict: bool = True) -> DataFrame:
    """Messages with the model's verdict on each enriched message."""
    enriched = decode_messages(messages, ENRICHED_SCHEMA, strict=strict)
    return encode_messages(scoring.score(model, enriched))


def clean_model_messages(messages: DataFrame, model: PipelineModel, strict: bool = True) -> DataFrame:
    """Messages with the transactions the model finds clean."""
    enriched = decode_messages(messages, ENRICHED_SCHEMA, strict=strict)
    return encode_messages(scoring.undetected_scored(model, enriched))


def detection_table(path: str) -> WriteBatch:
    """Keeps detections in a Parquet table, read as one row per ``tid``."""
    return lambda batch, batch_id: upsert_detections(batch, batch_id, path)


def start_detection_sink(
    messages: DataFrame, write: WriteBatch, checkpoint: str, available_now: bool = False, strict: bool = True
) -> StreamingQuery:
    """Keep a stream of detection messages in a table, such as :func:`detection_table`."""
    detections = decode_messages(messages, DETECTION_SCHEMA, fill_missing=True, strict=strict)
    return _start(detections.writeStream.foreachBatch(write), checkpoint, available_now)
