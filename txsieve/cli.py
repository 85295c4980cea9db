"""The jobs as commands: ``spark-submit run_job.py JOB ...``.

Messages are named ``kafka:TOPIC``, ``lines:FOLDER`` (JSON lines) or a folder of Parquet messages.
Tables are a Parquet folder, ``table:NAME`` of the catalog, ``jdbc:TABLE``, or
``jdbc:TABLE@COLUMN:LOW:HIGH:PARTS`` for a split scan; pair counts also ``parts:FOLDER``.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from txsieve.config import JobConfig
from txsieve.operators import evaluate, model
from txsieve.operators.enrich import PAIR, pair_counts
from txsieve.operators.rules import RuleSet
from txsieve.schema import DETECTION_SCHEMA, ENRICHED_SCHEMA, LABELLED_SCHEMA, RAW_SCHEMA
from txsieve.session import build_session
from txsieve.sinks.messages import KafkaTopic, MessageFolder, RecordTable
from txsieve.sinks.pair_counts import PARTS, add_pair_counts, merge_pair_counts, read_pair_counts, start_pair_counts
from txsieve.sinks.tables import (
    compact_detections,
    overwrite_jdbc,
    overwrite_table,
    save_bucketed,
    upsert_detections_jdbc,
    write_batch,
)
from txsieve.sources.messages import read_json_lines, read_kafka, read_message_table
from txsieve.sources.rules import load_rule_table, load_rule_xml
from txsieve.sources.tables import read_jdbc, read_table
from txsieve.streaming import jobs

_ACCOUNTS = "nameOrig string, nameDest string"
_PAIR_COUNTS = f"{_ACCOUNTS}, pairCount long"


class _Places:
    """Turns the names on the command line into frames and sinks."""

    def __init__(self, spark: SparkSession, config: JobConfig) -> None:
        self.spark, self.config = spark, config

    def messages(self, name: str, starting: str = "earliest") -> DataFrame:
        kind, _, rest = name.partition(":")
        if kind == "kafka":
            return read_kafka(self.spark, self.config, rest, starting=starting)
        if kind == "lines":
            return read_json_lines(self.spark, rest, stream=True)
        return read_message_table(self.spark, name, stream=True)

    def sink(self, name: str) -> KafkaTopic | MessageFolder:
        kind, _, rest = name.partition(":")
        if kind == "kafka":
            return KafkaTopic(self.config, rest)
        return MessageFolder(rest, "text") if kind == "lines" else MessageFolder(name)

    def table(self, name: str, schema: StructType | str) -> DataFrame:
        kind, _, rest = name.partition(":")
        if kind == "table":
            return self.spark.table(rest)
        if kind != "jdbc":
            return read_table(self.spark, name, schema)
        table, _, split = rest.partition("@")
        if not split:
            return read_jdbc(self.spark, self.config, table)
        column, low, high, parts = split.split(":")
        bounds = {"lower": int(low), "upper": int(high), "partitions": int(parts)}
        return read_jdbc(self.spark, self.config, table, partition_column=column, **bounds)

    def rules(self, path: str) -> RuleSet:
        for suffix in ("parquet", "csv", "json"):
            if path.rstrip("/").endswith(f".{suffix}"):
                return load_rule_table(self.spark, path, suffix)
        return load_rule_xml(self.spark, path)

    def detection_table(self, name: str) -> jobs.WriteBatch:
        kind, _, table = name.partition(":")
        if kind != "jdbc":
            return jobs.detection_table(name)
        return lambda batch, batch_id: upsert_detections_jdbc(batch, batch_id, self.config, table)

    def overwrite(self, df: DataFrame, name: str) -> None:
        kind, _, rest = name.partition(":")
        if kind == "jdbc":
            overwrite_jdbc(df, self.config, rest)
        else:
            overwrite_table(df, name)


def _run_enrichment(at: _Places, args: argparse.Namespace, outputs: list[jobs.WriteBatch]) -> None:
    quarantine = args.quarantine
    past = (args.pair_counts, _PAIR_COUNTS) if args.pair_counts else (args.history, _ACCOUNTS)
    kind, _, folder = (args.pair_counts or "").partition(":")
    jobs.start_enrichment(
        at.messages(args.source),
        history=lambda: at.table(*past),
        counts_for=(lambda batch: read_pair_counts(at.spark, folder, batch)) if kind == "parts" else None,
        blacklist=lambda: at.table(args.blacklist, "accountNumber string"),
        outputs=outputs,
        quarantine=(lambda df, batch_id: write_batch(df, batch_id, quarantine)) if quarantine else None,
        checkpoint=args.checkpoint,
        available_now=args.available_now,
    ).awaitTermination()


def _enrich(at: _Places, args: argparse.Namespace) -> None:
    if args.exactly_once:
        past = (args.pair_counts, _PAIR_COUNTS) if args.pair_counts else (args.history, _ACCOUNTS)
        kind, _, folder = past[0].partition(":")
        history = read_pair_counts(at.spark, folder) if kind == "parts" else at.table(*past)
        listed = at.table(args.blacklist, "accountNumber string")
        messages = jobs.enriched_messages(at.messages(args.source), history, listed, strict=not args.quarantine)
        _send(at, args, messages, RAW_SCHEMA)
    else:
        _run_enrichment(at, args, [at.sink(args.to).write_records])


def _screen(at: _Places, args: argparse.Namespace) -> None:
    outputs = []
    if args.rules:
        outputs.append(jobs.rule_output(at.rules(args.rules), at.detection_table(args.rules_to)))
    if args.model_to:
        fitted = _fitted(at, args, args.labelled)
        outputs.append(jobs.model_output(fitted, at.detection_table(args.model_to)))
    if args.to:
        outputs.append(at.sink(args.to).write_records)
    _run_enrichment(at, args, outputs)


def _fitted(at: _Places, args: argparse.Namespace, history: str | None) -> PipelineModel:
    """The saved model, the same at every restart, or one trained now."""
    if args.model_path:
        return model.load(args.model_path)
    return model.train(at.table(history, LABELLED_SCHEMA), args.model, handle_invalid=args.handle_invalid)


def _train(at: _Places, args: argparse.Namespace) -> None:
    fitted = _fitted(at, args, args.history)
    if args.publish:
        print(f"version {model.publish(fitted, at.spark, args.to)}")
    else:
        model.save(fitted, args.to)


def _score_versions(at: _Places, args: argparse.Namespace) -> None:
    source = at.messages(args.source)
    at.spark.streams.resetTerminated()
    write = RecordTable(args.to).write_records
    query = jobs.start_model_versions(
        source, args.models, write, args.checkpoint, args.available_now, strict=not args.quarantine
    )
    _finish(at, args, query, source, ENRICHED_SCHEMA)


def _merge_counts(at: _Places, args: argparse.Namespace) -> None:
    print(f"layers up to {merge_pair_counts(at.spark, args.table.removeprefix('parts:'))} are merged")


def _compact(at: _Places, args: argparse.Namespace) -> None:
    print(f"batches up to {compact_detections(at.spark, args.table)} are merged")


def _rules(at: _Places, args: argparse.Namespace) -> None:
    build = jobs.clean_rule_messages if args.clean else jobs.rule_messages
    _send(at, args, build(at.messages(args.source), at.rules(args.rules), strict=not args.quarantine))


def _score(at: _Places, args: argparse.Namespace) -> None:
    fitted = _fitted(at, args, args.history)
    build = jobs.clean_model_messages if args.clean else jobs.model_messages
    _send(at, args, build(at.messages(args.source), fitted, strict=not args.quarantine))


def _send(
    at: _Places, args: argparse.Namespace, messages: DataFrame, schema: StructType = ENRICHED_SCHEMA
) -> None:
    at.spark.streams.resetTerminated()
    query = jobs.start_messages(messages, at.sink(args.to), args.checkpoint, args.available_now)
    _finish(at, args, query, at.messages(args.source), schema)


def _finish(
    at: _Places, args: argparse.Namespace, query: StreamingQuery, source: DataFrame, schema: StructType
) -> None:
    """Wait for the job and for the second query that keeps its invalid messages; one that fails ends both."""
    queries = [query]
    if args.quarantine:
        checkpoint = args.checkpoint.rstrip("/") + "-quarantine"
        sink = MessageFolder(args.quarantine)
        queries.append(jobs.start_quarantine(source, schema, sink, checkpoint, args.available_now))
    while any(q.isActive for q in queries):
        at.spark.streams.awaitAnyTermination()
        at.spark.streams.resetTerminated()
    for ended in queries:
        ended.awaitTermination()


def _keep(at: _Places, args: argparse.Namespace) -> None:
    source, write = at.messages(args.source, args.starting), at.detection_table(args.to)
    at.spark.streams.resetTerminated()
    query = jobs.start_detection_sink(
        source, write, args.checkpoint, args.available_now, strict=not args.quarantine
    )
    _finish(at, args, query, source, DETECTION_SCHEMA)


def _pair_counts(at: _Places, args: argparse.Namespace) -> None:
    past = at.table(args.history, _ACCOUNTS)
    counts = pair_counts(past)
    kind, _, table = args.to.partition(":")
    if kind == "parts" and args.add:
        print(f"layer {add_pair_counts(past, table)}")
    elif kind == "parts":
        start_pair_counts(past, table, args.parts)
    elif kind == "table":
        save_bucketed(counts, table, PAIR, args.buckets)
    else:
        at.overwrite(counts, args.to)


def _evaluate(at: _Places, args: argparse.Namespace) -> None:
    found = at.table(args.detections, DETECTION_SCHEMA).select("tid", "isFraud")
    expected = at.table(args.expected, DETECTION_SCHEMA).select("tid", "isFraud")
    if args.frauds_only:
        found = evaluate.complete(found, expected)
    if args.pairs:
        at.overwrite(evaluate.eval_pairs(found, expected), args.pairs)
    print("\n".join(evaluate.report_lines(evaluate.metrics(found, expected))))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", help="JSON file with the fields of JobConfig")
    parser.add_argument("--master", help="Spark master, when not submitted with one")
    commands = parser.add_subparsers(dest="job", required=True)

    def stream(name: str, run, text: str, to: bool = True) -> argparse.ArgumentParser:
        command = commands.add_parser(name, help=text)
        command.set_defaults(run=run)
        command.add_argument("--from", dest="source", required=True, help="messages to read")
        command.add_argument("--to", required=to, help="where the results go")
        command.add_argument("--checkpoint", required=True, help="folder of this job's progress")
        command.add_argument("--available-now", action="store_true", help="end after what is there now")
        command.add_argument("--quarantine", help="folder for invalid messages, which fail the job without one")
        return command

    def lookups(command: argparse.ArgumentParser) -> None:
        past = command.add_mutually_exclusive_group(required=True)
        past.add_argument("--history", help="table of past transactions")
        past.add_argument("--pair-counts", help="table made by the job pair-counts")
        command.add_argument("--blacklist", required=True)

    enrich = stream("enrich", _enrich, "raw messages to enriched ones")
    lookups(enrich)
    enrich.add_argument(
        "--exactly-once",
        action="store_true",
        help="into a folder that other jobs may read live; lookups are read once, at the job's start",
    )

    screen = stream("screen", _screen, "raw messages to both detectors' tables in one job", to=False)
    lookups(screen)
    screen.add_argument("--rules", help="as for the job rules")
    screen.add_argument("--rules-to", help="table of the rules' detections")
    screen.add_argument("--model", choices=model.MODELS)
    screen.add_argument("--model-path", help="a model saved by the job train, instead of --model and --labelled")
    screen.add_argument("--labelled", help="labelled history to train the model on")
    screen.add_argument("--model-to", help="table of the model's verdicts")
    screen.add_argument("--handle-invalid", default="error", choices=("error", "keep"))

    rules = stream("rules", _rules, "detections of a rule set")
    rules.add_argument("--rules", required=True, help="XML document or rule table (.json, .csv, .parquet)")
    rules.add_argument("--clean", action="store_true", help="the transactions left instead")

    score = stream("score", _score, "verdicts of a model")
    score.add_argument("--model-path", help="a model saved by the job train, instead of --history and --model")
    score.add_argument("--history", help="labelled history to train on")
    score.add_argument("--model", choices=model.MODELS)
    score.add_argument("--handle-invalid", default="error", choices=("error", "keep"))
    score.add_argument("--clean", action="store_true", help="the transactions found clean instead")

    train = commands.add_parser("train", help="a model of labelled history, saved for score and screen")
    train.set_defaults(run=_train, model_path=None)
    train.add_argument("--history", required=True)
    train.add_argument("--model", required=True, choices=model.MODELS)
    train.add_argument("--to", required=True, help="folder of the model, replaced if it exists")
    train.add_argument("--handle-invalid", default="error", choices=("error", "keep"))
    train.add_argument("--publish", action="store_true", help="as the next version of a folder, for the job score-versions")

    versions = stream("score-versions", _score_versions, "verdicts of the latest model of a folder into a table")
    versions.add_argument("--models", required=True, help="folder of models that train --publish fills")

    compact = commands.add_parser("compact", help="merge the batches of a detection table, also while its job runs")
    compact.set_defaults(run=_compact)
    compact.add_argument("--table", required=True)

    keep = stream("keep", _keep, "detection messages into a table")
    keep.add_argument("--starting", default="earliest", choices=("earliest", "latest"))

    counts = commands.add_parser("pair-counts", help="count past transactions per pair of accounts")
    counts.set_defaults(run=_pair_counts)
    counts.add_argument("--history", required=True)
    counts.add_argument("--to", required=True)
    counts.add_argument("--parts", type=int, default=PARTS, help="of a new parts:FOLDER, of which a batch reads its own parts")
    counts.add_argument("--add", action="store_true", help="add to a parts:FOLDER instead of starting it")
    counts.add_argument("--buckets", type=int, default=1024, help="of a table:NAME, which is kept in buckets")

    merge = commands.add_parser("merge-pair-counts", help="sum the layers of a parts:FOLDER, also while jobs read it")
    merge.set_defaults(run=_merge_counts)
    merge.add_argument("--table", required=True)

    judge = commands.add_parser("evaluate", help="detections against expected labels")
    judge.set_defaults(run=_evaluate)
    judge.add_argument("--detections", required=True)
    judge.add_argument("--expected", required=True)
    judge.add_argument("--pairs", help="table to write (tid, expected, actual) to")
    judge.add_argument("--frauds-only", action="store_true", help="the detections hold no clean verdicts")
    return parser


def main(arguments: Sequence[str] | None = None) -> None:
    parser = _parser()
    args = parser.parse_args(arguments)
    if args.job == "screen":
        if not (args.rules or args.model or args.model_path):
            parser.error("screen needs --rules, --model or --model-path")
        if bool(args.rules) != bool(args.rules_to):
            parser.error("--rules goes with --rules-to")
        if bool(args.model or args.model_path) != bool(args.model_to):
            parser.error("--model and --model-path go with --model-to")
    if args.job in ("score", "screen"):
        history = args.history if args.job == "score" else args.labelled
        wanted = args.job == "score" or args.model_to
        if bool(args.model) != bool(history) or wanted and bool(args.model) == bool(args.model_path):
            parser.error("give --model-path, or --model with the labelled history")
    config = JobConfig.from_json(args.config) if args.config else JobConfig()
    spark = build_session(f"txsieve-{args.job}", args.master)
    args.run(_Places(spark, config), args)
