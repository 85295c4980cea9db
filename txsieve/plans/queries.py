"""Every operator as a query over the test tables. Floats are given as doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import FloatType, StructType

from txsieve.functions.messages import decode_messages, encode_messages, parse_messages
from txsieve.operators import enrich as enriching
from txsieve.operators import evaluate, model, rules, tree_sql
from txsieve.operators.rule_index import RuleIndex
from txsieve.operators.rules import Compound, Rule, RuleSet
from txsieve.plans import tables
from txsieve.plans.sample_rules import sample_rule_table, sample_rules
from txsieve.schema import DETECTION_SCHEMA, ENRICHED_SCHEMA, MESSAGE_SCHEMA, RAW_SCHEMA
from txsieve.session import new_run_folder
from txsieve.sinks import pair_counts as counting
from txsieve.sinks import tables as sinks
from txsieve.sinks.messages import MessageFolder, RecordTable
from txsieve.sources.messages import read_json_lines, read_message_table
from txsieve.sources.rules import load_rule_table
from txsieve.sources.tables import read_table
from txsieve.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]


def _doubles(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FloatType)}
    return df.select(*[F.col(c).cast("double").alias(c) if c in floats else F.col(c) for c in df.columns])


# Sources and messages


def scan_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(tables.raw_live(spark, sf_dir))


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(tables.labelled_history(spark, sf_dir))


def decode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = encode_messages(tables.raw_live(spark, sf_dir))
    return _doubles(decode_messages(messages, RAW_SCHEMA, fill_missing=True))


def scan_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions written as JSON lines and read as a stream of messages."""
    lines, folder = new_run_folder(spark, "lines"), new_run_folder(spark, "records")
    sinks.write_text(encode_messages(tables.raw_live(spark, sf_dir)), lines)
    decoded = decode_messages(read_json_lines(spark, lines, stream=True), RAW_SCHEMA, fill_missing=True)
    writer = decoded.writeStream.option("checkpointLocation", new_run_folder(spark, "checkpoint"))
    writer.trigger(availableNow=True).start(folder).awaitTermination()
    return _doubles(read_table(spark, folder, RAW_SCHEMA))


def _partly_invalid(records: DataFrame, bad: Column) -> DataFrame:
    """Messages of the records; the ``bad`` ones are invalid.

    By ``tid`` they have it as text, are two objects, an object and garbage, name it twice, or close the place they are
    read in and open another one, which hides their record behind a second.
    """
    others = [c for c in records.columns if c != "tid"]
    as_text = F.to_json(F.struct(F.col("tid").cast("string").alias("tid"), *others))
    good = F.to_json(F.struct("*"))
    second = F.concat(F.lit('{"tid":'), (F.col("tid") + 1).cast("string"), F.lit("}"))
    twice = F.concat(F.lit('{"tid":0,'), F.substring(good, 2, 1_000_000))
    ways = [
        as_text,
        F.concat_ws(" ", good, good),
        F.concat(good, F.lit(" x")),
        twice,
        F.concat(good, F.lit('],"all":['), second),
        F.concat(good, F.lit('] , "all":[ '), second),
    ]
    invalid = F.element_at(F.array(*ways), (F.pmod("tid", F.lit(len(ways))) + 1).cast("int"))
    value = F.when(bad, invalid).otherwise(good)
    return records.select(F.col("tid").cast("string").alias("key"), value.alias("value"))


def decode_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _partly_invalid(tables.raw_live(spark, sf_dir), F.col("type") == "ERROR")
    return parse_messages(messages, RAW_SCHEMA).select(
        F.col("key").cast("long").alias("tid"), (~F.col("valid")).cast("int").alias("quarantined")
    )


def decode_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.verdicts(tables.enriched_live(spark, sf_dir), sample_rules())
    return decode_messages(encode_messages(found), DETECTION_SCHEMA, fill_missing=True)


def encode_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_messages(rules.detections(tables.enriched_live(spark, sf_dir), sample_rules()))


def encode_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_messages(tables.enriched_live(spark, sf_dir), keep_nulls=True)


# Enrichment


def recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, past = tables.raw_live(spark, sf_dir), tables.raw_history(spark, sf_dir)
    accounts = tables.live_accounts(spark, sf_dir)
    return enriching.add_recurrence(live, past, accounts).select("tid", "recurrence")


def recurrence_hot_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all transactions, live and past, is between two accounts; their rows are dealt to several tasks."""
    live, past = (tables.with_hot_pair(t(spark, sf_dir)) for t in (tables.raw_live, tables.raw_history))
    return enriching.add_recurrence(live, past, rows_per_task=100).select("tid", "recurrence")


def _counts_in_parts(spark: SparkSession, sf_dir: str) -> str:
    """The history's pair counts as a table in parts, of which the second half came later and a merge took place between."""
    folder, past = new_run_folder(spark, "pair-counts"), tables.raw_history(spark, sf_dir)
    early = F.col("step") < 180
    counting.start_pair_counts(past.filter(early & (F.col("step") < 90)), folder, parts=32)
    counting.add_pair_counts(past.filter(early & (F.col("step") >= 90)), folder)
    counting.merge_pair_counts(spark, folder)
    counting.add_pair_counts(past.filter(~early), folder)
    return folder


def recurrence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a table of pair counts of which the live transactions' parts are read."""
    live, folder = tables.raw_live(spark, sf_dir), _counts_in_parts(spark, sf_dir)
    counts = counting.read_pair_counts(spark, folder, tables.live_accounts(spark, sf_dir))
    return enriching.add_recurrence(live, counts, few=True).select("tid", "recurrence")


def dest_blacklisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, listed = tables.raw_live(spark, sf_dir), tables.blacklist(spark, sf_dir)
    return enriching.add_dest_blacklisted(live, listed).select("tid", "destBlacklisted")


def balance_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = enriching.add_balance_errors(tables.raw_live(spark, sf_dir))
    return live.select("tid", "errorBalanceOrig", "errorBalanceDest")


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(tables.enriched_live(spark, sf_dir))


# Rules


def _rule_query(rule: Rule | Compound, *shown: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.matching(tables.raw_live(spark, sf_dir), RuleSet((rule,)))
        return _doubles(found.select("tid", *shown))

    return run


_LOW_BALANCE = Rule(1, "newBalanceOrig", "lessThan", "500")
_LARGE = Rule(2, "amount", "greaterThan", "100")
_FAILED = Rule(3, "type", "equalTo", "ERROR", "string")

RULE_QUERIES = {
    "rule_lt": _rule_query(Rule(1, "newBalanceOrig", "lessThan", "200"), "newBalanceOrig"),
    "rule_le": _rule_query(Rule(1, "step", "lessThanOrEqualTo", "480"), "step"),
    "rule_gt": _rule_query(Rule(1, "amount", "greaterThan", "100"), "amount"),
    "rule_ge": _rule_query(Rule(1, "step", "greaterThanOrEqualTo", "480"), "step"),
    "rule_eq": _rule_query(Rule(1, "newBalanceOrig", "equalTo", "0"), "newBalanceOrig"),
    "rule_ne": _rule_query(Rule(1, "type", "notEqualTo", "VIEW", "string"), "type"),
    "rule_int_literal": _rule_query(Rule(1, "step", "equalTo", "500", "int"), "step"),
    "rule_float_literal": _rule_query(Rule(1, "amount", "lessThanOrEqualTo", "12.31", "float"), "amount"),
    "rule_string_literal": _rule_query(Rule(1, "nameDest", "equalTo", "M69", "string"), "nameDest"),
    "rule_column_compare": _rule_query(
        Rule(1, "newBalanceDest", "greaterThan", "newBalanceOrig", "column"), "newBalanceOrig", "newBalanceDest"
    ),
    "rule_and": _rule_query(Compound(9, "AND", _LOW_BALANCE, _FAILED), "newBalanceOrig", "type"),
    "rule_or": _rule_query(Compound(9, "OR", _LARGE, _FAILED), "amount", "type"),
    "rule_nested": _rule_query(
        Compound(9, "OR", Compound(8, "AND", _LOW_BALANCE, _LARGE), Compound(7, "AND", _LARGE, _FAILED)),
        "newBalanceOrig",
        "amount",
        "type",
    ),
}


def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(rules.matching(tables.enriched_live(spark, sf_dir), sample_rules()))


def rule_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_run_folder(spark, "rules")
    sample_rule_table(spark).write.json(folder)
    loaded = load_rule_table(spark, folder, "json")
    return _doubles(rules.matching(tables.enriched_live(spark, sf_dir), loaded))


def sql_view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.enriched_live(spark, sf_dir).createOrReplaceTempView("trdata")
    return _doubles(rules.matching_view(spark, "trdata", sample_rules()))


def det_prim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.detections(tables.enriched_live(spark, sf_dir), sample_rules())


def undetected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(rules.undetected(tables.enriched_live(spark, sf_dir), sample_rules()))


def rule_index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a rule set that grows with the history and is looked up in an index."""
    live, learned = tables.raw_live(spark, sf_dir), tables.learned_rules(spark, sf_dir)
    judged, condition = RuleIndex(learned, live.schema).matched(live)
    return judged.select("tid", condition.cast("int").alias("isFraud"))


def rule_index_undetected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions that set leaves, compiled or looked up by its size."""
    return _doubles(rules.undetected(tables.raw_live(spark, sf_dir), tables.learned_rules(spark, sf_dir)))


# Models


def type_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = model.fit_features(tables.labelled_history(spark, sf_dir))
    return fitted.transform(tables.enriched_live(spark, sf_dir)).select("tid", "type", "typeIndex")


def _spread(vector: str, prefix: str, size: int) -> list:
    values = vector_to_array(F.col(vector))
    return [values[i].alias(f"{prefix}{i}") for i in range(size)]


def type_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = model.fit_features(tables.labelled_history(spark, sf_dir))
    types = len(fitted.stages[0].labels) - 1
    encoded = fitted.transform(tables.enriched_live(spark, sf_dir))
    return encoded.select("tid", *_spread("typeVec", "t", types))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = model.fit_features(tables.labelled_history(spark, sf_dir))
    width = len(fitted.stages[0].labels) - 1 + len(model.NUMERIC_FEATURES)
    assembled = fitted.transform(tables.enriched_live(spark, sf_dir))
    return assembled.select("tid", *_spread("features", "f", width))


def _score_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fitted = model.train(tables.labelled_history(spark, sf_dir), name)
        return model.score(fitted, tables.enriched_live(spark, sf_dir))

    return run


def det_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's verdicts as they arrive from its messages."""
    fitted = model.train(tables.labelled_history(spark, sf_dir), "RANDOM_FOREST")
    enriched = encode_messages(tables.enriched_live(spark, sf_dir))
    return decode_messages(jobs.model_messages(enriched, fitted), DETECTION_SCHEMA, fill_missing=True)


def undetected_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = model.train(tables.labelled_history(spark, sf_dir), "LOGISTIC_REGRESSION")
    return _doubles(model.undetected_scored(fitted, tables.enriched_live(spark, sf_dir)))


def _compiled_query(name: str) -> Query:
    """Whether a tree model's verdict by its SQL expression is the one the fitted model gives, for every live transaction."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fitted, live = model.train(tables.labelled_history(spark, sf_dir), name), tables.enriched_live(spark, sf_dir)
        scored = fitted.transform(live).select("tid", F.col("prediction").cast("int").alias("whole"), *_inputs())
        trees = tree_sql.compiled(spark, fitted)
        return scored.select("tid", (trees.to_column() == F.col("whole")).cast("int").alias("agrees"))

    return run


def _inputs() -> list[str]:
    return ["type", *model.NUMERIC_FEATURES]


def det_sec_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression's verdicts as they arrive from its messages, beside the fitted model's."""
    fitted = model.train(tables.labelled_history(spark, sf_dir), "RANDOM_FOREST")
    live = tables.enriched_live(spark, sf_dir)
    sent = encode_messages(tree_sql.score(tree_sql.compiled(spark, fitted), live))
    found = decode_messages(sent, DETECTION_SCHEMA, fill_missing=True)
    whole = model.score(fitted, live).withColumnRenamed("isFraud", "whole")
    return found.join(whole, "tid").select("tid", (F.col("isFraud") == F.col("whole")).cast("int").alias("agrees"))


# The models on a label that one input decides, so that SQL can say what each must find

_TWO_TYPES = "type IN ('VIEW', 'CLICK')"


def _train_on_types(spark: SparkSession, sf_dir: str, name: str) -> PipelineModel:
    """Learns to tell views from clicks, which about half of the training rows are."""
    history = tables.labelled_history(spark, sf_dir).filter(_TWO_TYPES)
    return model.train(history.withColumn("isFraud", (F.col("type") == "VIEW").cast("int")), name)


def _types_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        live = tables.enriched_live(spark, sf_dir).filter(_TWO_TYPES)
        return model.score(_train_on_types(spark, sf_dir, name), live)

    return run


def det_sec_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _train_on_types(spark, sf_dir, "RANDOM_FOREST")
    enriched = encode_messages(tables.enriched_live(spark, sf_dir).filter(_TWO_TYPES))
    return decode_messages(jobs.model_messages(enriched, fitted), DETECTION_SCHEMA, fill_missing=True)


def undetected_scored_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = tables.enriched_live(spark, sf_dir).filter(_TWO_TYPES)
    return _doubles(model.undetected_scored(_train_on_types(spark, sf_dir, "LOGISTIC_REGRESSION"), live))


def eval_metrics_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _types_query("GBT")(spark, sf_dir)
    return evaluate.metrics(found, tables.expected_detections(spark, sf_dir))


def stream_score_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring job on a topic, with a model that was saved and loaded as a restarted job does."""
    path, topic = new_run_folder(spark, "model"), new_run_folder(spark, "topic")
    model.save(_train_on_types(spark, sf_dir, "LOGISTIC_REGRESSION"), path)
    sinks.overwrite_table(encode_messages(tables.enriched_live(spark, sf_dir).filter(_TWO_TYPES)), topic)
    source = read_message_table(spark, topic, stream=True)
    sent = _send(spark, jobs.model_messages(source, model.load(path)))
    return decode_messages(read_message_table(spark, sent), DETECTION_SCHEMA)


# Evaluation


def eval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.verdicts(tables.enriched_live(spark, sf_dir), sample_rules())
    return evaluate.eval_pairs(found, tables.expected_detections(spark, sf_dir))


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the detections alone: transactions without one count as found clean."""
    expected = tables.expected_detections(spark, sf_dir)
    return evaluate.confusion(evaluate.complete(det_prim(spark, sf_dir), expected), expected)


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.verdicts(tables.enriched_live(spark, sf_dir), sample_rules())
    return evaluate.metrics(found, tables.expected_detections(spark, sf_dir))


def eval_metrics_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _score_query("LOGISTIC_REGRESSION")(spark, sf_dir)
    return evaluate.metrics(found, tables.expected_detections(spark, sf_dir))


# Streams and sinks


def _run_enrichment(spark: SparkSession, sf_dir: str, outputs: list[jobs.WriteBatch]) -> None:
    jobs.start_enrichment(
        encode_messages(tables.raw_live_stream(spark, sf_dir)),
        history=lambda: tables.raw_history(spark, sf_dir),
        blacklist=lambda: tables.blacklist(spark, sf_dir),
        outputs=outputs,
        checkpoint=new_run_folder(spark, "checkpoint"),
        available_now=True,
    ).awaitTermination()


def _enriched_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched messages as a stream, from the folder an enrichment job has filled."""
    topic = new_run_folder(spark, "enriched")
    _run_enrichment(spark, sf_dir, [MessageFolder(topic).write_records])
    return read_message_table(spark, topic, stream=True)


def _send(spark: SparkSession, messages: DataFrame) -> str:
    """Run a message job to its end and name the folder it fills."""
    folder = new_run_folder(spark, "messages")
    checkpoint = new_run_folder(spark, "checkpoint")
    jobs.start_messages(messages, MessageFolder(folder), checkpoint, available_now=True).awaitTermination()
    return folder


def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_run_folder(spark, "enriched")
    _run_enrichment(spark, sf_dir, [RecordTable(folder).write_records])
    return _doubles(read_table(spark, folder, ENRICHED_SCHEMA).select(*ENRICHED_SCHEMA.fieldNames()))


def stream_enrich_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enrichment job with pair counts of which each batch reads its own parts."""
    counts, folder = _counts_in_parts(spark, sf_dir), new_run_folder(spark, "enriched")
    jobs.start_enrichment(
        encode_messages(tables.raw_live_stream(spark, sf_dir)),
        history=None,
        counts_for=lambda batch: counting.read_pair_counts(spark, counts, batch),
        blacklist=lambda: tables.blacklist(spark, sf_dir),
        outputs=[RecordTable(folder).write_records],
        checkpoint=new_run_folder(spark, "checkpoint"),
        available_now=True,
    ).awaitTermination()
    return _doubles(read_table(spark, folder, ENRICHED_SCHEMA).select(*ENRICHED_SCHEMA.fieldNames()))


def stream_rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _send(spark, jobs.rule_messages(_enriched_messages(spark, sf_dir), sample_rules()))
    return decode_messages(read_message_table(spark, sent), DETECTION_SCHEMA)


def stream_undetected(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _send(spark, jobs.clean_rule_messages(_enriched_messages(spark, sf_dir), sample_rules()))
    return _doubles(decode_messages(read_message_table(spark, sent), ENRICHED_SCHEMA))


def stream_sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _send(spark, jobs.rule_messages(_enriched_messages(spark, sf_dir), sample_rules()))
    table = new_run_folder(spark, "detections")
    jobs.start_detection_sink(
        read_message_table(spark, sent, stream=True),
        jobs.detection_table(table),
        new_run_folder(spark, "checkpoint"),
        available_now=True,
    ).awaitTermination()
    return sinks.read_detections(spark, table)


def _both(good: DataFrame, bad: DataFrame) -> DataFrame:
    """What a job wrote and the messages it set aside."""
    kept = good.select("tid", F.lit(0).alias("quarantined"))
    return kept.unionByName(bad.select(F.col("key").cast("long").alias("tid"), F.lit(1).alias("quarantined")))


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enrichment job on messages of which those of failed transactions are invalid."""
    good, bad = new_run_folder(spark, "enriched"), new_run_folder(spark, "invalid")
    jobs.start_enrichment(
        _partly_invalid(tables.raw_live_stream(spark, sf_dir), F.col("type") == "ERROR"),
        history=lambda: tables.raw_history(spark, sf_dir),
        blacklist=lambda: tables.blacklist(spark, sf_dir),
        outputs=[RecordTable(good).write_records],
        quarantine=RecordTable(bad).write_records,
        checkpoint=new_run_folder(spark, "checkpoint"),
        available_now=True,
    ).awaitTermination()
    return _both(read_table(spark, good, ENRICHED_SCHEMA), read_table(spark, bad, MESSAGE_SCHEMA))


def _set_aside(spark: SparkSession, topic: str, schema: StructType) -> DataFrame:
    """The invalid messages of a topic, as the query beside a job keeps them."""
    bad = new_run_folder(spark, "invalid")
    source = read_message_table(spark, topic, stream=True)
    checkpoint = new_run_folder(spark, "checkpoint")
    jobs.start_quarantine(source, schema, MessageFolder(bad), checkpoint, available_now=True).awaitTermination()
    return read_message_table(spark, bad)


def stream_rule_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rule jobs, detections and the rest, on enriched messages of which failed transactions' are invalid."""
    topic = new_run_folder(spark, "topic")
    sinks.overwrite_table(_partly_invalid(tables.enriched_live(spark, sf_dir), F.col("type") == "ERROR"), topic)
    source = read_message_table(spark, topic, stream=True)
    sent = [
        _send(spark, build(source, sample_rules(), strict=False))
        for build in (jobs.rule_messages, jobs.clean_rule_messages)
    ]
    found, clean = [decode_messages(read_message_table(spark, folder), DETECTION_SCHEMA) for folder in sent]
    return _both(found.unionByName(clean), _set_aside(spark, topic, ENRICHED_SCHEMA))


def stream_keep_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that keeps detections, on verdicts of which the frauds' are invalid."""
    topic, table = new_run_folder(spark, "topic"), new_run_folder(spark, "detections")
    found = rules.verdicts(tables.enriched_live(spark, sf_dir), sample_rules())
    sinks.overwrite_table(_partly_invalid(found, F.col("isFraud") == 1), topic)
    jobs.start_detection_sink(
        read_message_table(spark, topic, stream=True),
        jobs.detection_table(table),
        new_run_folder(spark, "checkpoint"),
        available_now=True,
        strict=False,
    ).awaitTermination()
    return _both(sinks.read_detections(spark, table), _set_aside(spark, topic, DETECTION_SCHEMA))


def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections kept in a table that is merged after every second batch while its stream runs."""
    topic, table = new_run_folder(spark, "topic"), new_run_folder(spark, "detections")
    found = encode_messages(rules.detections(tables.enriched_live(spark, sf_dir), sample_rules()))
    sinks.overwrite_table(found.repartition(4, "key"), topic)
    write = jobs.detection_table(table)

    def write_and_merge(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        if batch_id % 2:
            sinks.compact_detections(spark, table)

    source = read_message_table(spark, topic, stream=True, files_per_trigger=1)
    checkpoint = new_run_folder(spark, "checkpoint")
    jobs.start_detection_sink(source, write_and_merge, checkpoint, available_now=True).awaitTermination()
    return sinks.read_detections(spark, table)


def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two outputs that only ever add got each transaction, of which the second fails at its first batch and the job is restarted."""
    folders, checkpoint = [new_run_folder(spark, "output") for _ in range(2)], new_run_folder(spark, "checkpoint")
    failed = []

    def adds(folder: str) -> jobs.WriteBatch:
        return lambda batch, batch_id: batch.write.mode("append").parquet(folder)

    def fails_once(batch: DataFrame, batch_id: int) -> None:
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("the second output's first attempt")
        adds(folders[1])(batch, batch_id)

    def start() -> StreamingQuery:
        return jobs.start_enrichment(
            encode_messages(tables.raw_live_stream(spark, sf_dir)),
            history=lambda: tables.raw_history(spark, sf_dir),
            blacklist=lambda: tables.blacklist(spark, sf_dir),
            outputs=[adds(folders[0]), fails_once],
            checkpoint=checkpoint,
            available_now=True,
        )

    try:
        start().awaitTermination()
    except StreamingQueryException:
        spark.streams.resetTerminated()
    start().awaitTermination()
    counted = [
        read_table(spark, folder, ENRICHED_SCHEMA).groupBy("tid").agg(F.count("*").alias(f"{name}_times"))
        for folder, name in zip(folders, ("first", "second"), strict=True)
    ]
    return counted[0].join(counted[1], "tid", "full")


def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule job on a folder that the enrichment job fills so that each message comes once."""
    raw = encode_messages(tables.raw_live_stream(spark, sf_dir))
    enriched = jobs.enriched_messages(raw, tables.raw_history(spark, sf_dir), tables.blacklist(spark, sf_dir))
    source = read_message_table(spark, _send(spark, enriched), stream=True)
    return decode_messages(read_message_table(spark, _send(spark, jobs.rule_messages(source, sample_rules()))), DETECTION_SCHEMA)


def stream_model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the latest of a folder's models, of which a second one comes while the stream runs."""
    models, topic, table = (new_run_folder(spark, name) for name in ("models", "topic", "verdicts"))
    fitted = model.train(tables.labelled_history(spark, sf_dir), "LOGISTIC_REGRESSION")
    model.publish(fitted, spark, models)
    sinks.overwrite_table(encode_messages(tables.enriched_live(spark, sf_dir)).repartition(3, "key"), topic)
    write = RecordTable(table).write_records

    def write_and_publish(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        if batch_id == 0:
            model.publish(fitted, spark, models)

    source = read_message_table(spark, topic, stream=True, files_per_trigger=1)
    checkpoint = new_run_folder(spark, "checkpoint")
    jobs.start_model_versions(source, models, write_and_publish, checkpoint, available_now=True).awaitTermination()
    return read_table(spark, table, DETECTION_SCHEMA).select("tid", "isFraud")


def stream_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job that enriches each batch once and keeps the verdicts of both detectors."""
    fitted = model.train(tables.labelled_history(spark, sf_dir), "LOGISTIC_REGRESSION")
    by_rules, by_model = new_run_folder(spark, "by-rules"), new_run_folder(spark, "by-model")
    outputs = [
        jobs.rule_output(sample_rules(), jobs.detection_table(by_rules)),
        jobs.model_output(fitted, jobs.detection_table(by_model)),
    ]
    _run_enrichment(spark, sf_dir, outputs)
    found = sinks.read_detections(spark, by_rules).withColumn("detector", F.lit("rules"))
    scored = sinks.read_detections(spark, by_model).withColumn("detector", F.lit("model"))
    return found.unionByName(scored)


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = model.train(tables.labelled_history(spark, sf_dir), "LOGISTIC_REGRESSION")
    sent = _send(spark, jobs.model_messages(_enriched_messages(spark, sf_dir), fitted))
    return decode_messages(read_message_table(spark, sent), DETECTION_SCHEMA)


def sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write replaces the first."""
    folder = new_run_folder(spark, "table")
    sinks.overwrite_table(tables.expected_detections(spark, sf_dir), folder)
    sinks.overwrite_table(det_prim(spark, sf_dir), folder)
    return read_table(spark, folder, DETECTION_SCHEMA)


def sink_eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_run_folder(spark, "pairs")
    sinks.overwrite_table(eval_join(spark, sf_dir), folder)
    return read_table(spark, folder, "tid long, expected int, actual int")


def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_run_folder(spark, "text")
    sinks.write_text(encode_detection(spark, sf_dir), folder)
    return spark.read.text(folder)


QUERIES: dict[str, Query] = {
    "scan_transactions": scan_transactions,
    "scan_history": scan_history,
    "scan_json_lines": scan_json_lines,
    "decode_json": decode_json,
    "decode_quarantine": decode_quarantine,
    "decode_detection": decode_detection,
    "encode_detection": encode_detection,
    "encode_enriched": encode_enriched,
    "recurrence": recurrence,
    "recurrence_hot_pair": recurrence_hot_pair,
    "recurrence_parts": recurrence_parts,
    "dest_blacklisted": dest_blacklisted,
    "balance_error": balance_error,
    "enrich": enrich,
    **RULE_QUERIES,
    "rule_filter": rule_filter,
    "rule_table_filter": rule_table_filter,
    "sql_view_filter": sql_view_filter,
    "det_prim": det_prim,
    "undetected": undetected,
    "rule_index_filter": rule_index_filter,
    "rule_index_undetected": rule_index_undetected,
    "type_index": type_index,
    "type_onehot": type_onehot,
    "features": features,
    "score_rf": _score_query("RANDOM_FOREST"),
    "score_gbt": _score_query("GBT"),
    "score_lr": _score_query("LOGISTIC_REGRESSION"),
    "det_sec": det_sec,
    "score_rf_compiled": _compiled_query("RANDOM_FOREST"),
    "score_gbt_compiled": _compiled_query("GBT"),
    "det_sec_compiled": det_sec_compiled,
    "undetected_scored": undetected_scored,
    "score_rf_types": _types_query("RANDOM_FOREST"),
    "score_gbt_types": _types_query("GBT"),
    "score_lr_types": _types_query("LOGISTIC_REGRESSION"),
    "det_sec_types": det_sec_types,
    "undetected_scored_types": undetected_scored_types,
    "eval_metrics_types": eval_metrics_types,
    "stream_score_types": stream_score_types,
    "eval_join": eval_join,
    "eval_confusion": eval_confusion,
    "eval_metrics": eval_metrics,
    "eval_metrics_scored": eval_metrics_scored,
    "stream_enrich": stream_enrich,
    "stream_enrich_parts": stream_enrich_parts,
    "stream_rule_filter": stream_rule_filter,
    "stream_undetected": stream_undetected,
    "stream_sink_upsert": stream_sink_upsert,
    "stream_quarantine": stream_quarantine,
    "stream_rule_quarantine": stream_rule_quarantine,
    "stream_keep_quarantine": stream_keep_quarantine,
    "stream_snapshots": stream_snapshots,
    "stream_fan_out": stream_fan_out,
    "stream_chain": stream_chain,
    "stream_model_versions": stream_model_versions,
    "stream_screening": stream_screening,
    "stream_score": stream_score,
    "sink_overwrite": sink_overwrite,
    "sink_eval_pairs": sink_eval_pairs,
    "sink_text": sink_text,
}
