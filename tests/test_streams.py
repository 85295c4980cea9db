import pytest
from pyspark.sql import functions as F

from txsieve.functions.messages import decode_messages, encode_messages
from txsieve.operators import lookup, model, rules
from txsieve.operators.enrich import enrich, pair_counts
from txsieve.plans import tables
from txsieve.plans.sample_rules import sample_rules
from txsieve.schema import DETECTION_SCHEMA, ENRICHED_SCHEMA, MESSAGE_SCHEMA
from txsieve.sinks.messages import MessageFolder, RecordTable
from txsieve.sinks.tables import overwrite_table, read_detections
from txsieve.sources.messages import read_json_lines, read_message_table
from txsieve.sources.tables import read_table
from txsieve.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def live(spark):
    return tables.raw_live(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def past(spark):
    return tables.raw_history(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def listed(spark):
    return tables.blacklist(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def batch_result(live, past, listed):
    return enrich(live, past, listed).persist()


@pytest.fixture
def json_files(live, folder):
    """The live transactions as JSON lines in four files."""
    path = folder("lines")
    encode_messages(live).select("value").repartition(4).write.text(path)
    return path


def _rows(df):
    return sorted(df.collect(), key=str)


def _ended(query):
    query.awaitTermination()
    return query


def test_enrichment_equals_batch(spark, json_files, past, listed, batch_result, folder):
    for history in (past, pair_counts(past)):
        out = folder()
        query = jobs.start_enrichment(
            read_json_lines(spark, json_files, stream=True, files_per_trigger=1),
            history=lambda: history,
            blacklist=lambda: listed,
            outputs=[RecordTable(out).write_records],
            checkpoint=folder("checkpoint"),
            available_now=True,
        )
        assert len(_ended(query).recentProgress) >= 4
        assert _rows(read_table(spark, out, ENRICHED_SCHEMA).drop("batch_id")) == _rows(batch_result)


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_enriched_messages_into_a_folder(spark, json_files, past, listed, batch_result, folder, fmt):
    out = folder()
    _ended(
        jobs.start_enrichment(
            read_json_lines(spark, json_files, stream=True, files_per_trigger=2),
            history=lambda: past,
            blacklist=lambda: listed,
            outputs=[MessageFolder(out, fmt).write_records],
            checkpoint=folder("checkpoint"),
            available_now=True,
        )
    )
    sent = read_message_table(spark, out) if fmt == "parquet" else read_json_lines(spark, out)
    assert _rows(decode_messages(sent, ENRICHED_SCHEMA)) == _rows(batch_result)


def test_bad_messages_are_kept_apart(spark, past, listed, folder):
    lines, good, bad = folder(), folder(), folder()
    values = [('{"tid":1,"type":"VIEW"}',), ("junk",), ('{"tid":"2"}',)]
    spark.createDataFrame(values, "value string").write.text(lines)
    _ended(
        jobs.start_enrichment(
            read_json_lines(spark, lines, stream=True),
            history=lambda: past,
            blacklist=lambda: listed,
            outputs=[RecordTable(good).write_records],
            quarantine=RecordTable(bad).write_records,
            checkpoint=folder("checkpoint"),
            available_now=True,
        )
    )
    (row,) = read_table(spark, good, ENRICHED_SCHEMA).collect()
    assert (row["tid"], row["type"], row["amount"], row["recurrence"]) == (1, "VIEW", 0.0, 0)
    assert {r["value"] for r in read_table(spark, bad, MESSAGE_SCHEMA).collect()} == {"junk", '{"tid":"2"}'}


def test_without_a_quarantine_a_bad_message_fails_each_job(spark, past, listed, folder):
    lines = folder()
    spark.createDataFrame([("junk",)], "value string").write.text(lines)
    source = read_json_lines(spark, lines, stream=True)
    enriching = jobs.start_enrichment(
        source, lambda: past, lambda: listed, [RecordTable(folder()).write_records], folder(), available_now=True
    )
    screening = jobs.start_messages(
        jobs.rule_messages(source, sample_rules()), MessageFolder(folder()), folder(), available_now=True
    )
    keeping = jobs.start_detection_sink(source, jobs.detection_table(folder()), folder(), available_now=True)
    for query in (enriching, screening, keeping):
        with pytest.raises(Exception, match="invalid message: junk"):
            _ended(query)


def test_fan_out_to_both_detectors(spark, json_files, past, listed, batch_result, folder):
    history = tables.labelled_history(spark, SF_DIR)
    fitted = model.train(history)
    by_rules, by_model = folder(), folder()
    _ended(
        jobs.start_enrichment(
            read_json_lines(spark, json_files, stream=True, files_per_trigger=2),
            history=lambda: past,
            blacklist=lambda: listed,
            outputs=[
                jobs.rule_output(sample_rules(), jobs.detection_table(by_rules)),
                jobs.model_output(fitted, jobs.detection_table(by_model)),
            ],
            checkpoint=folder("checkpoint"),
            available_now=True,
        )
    )
    assert _rows(read_detections(spark, by_rules)) == _rows(rules.detections(batch_result, sample_rules()))
    assert _rows(read_detections(spark, by_model)) == _rows(model.score(fitted, batch_result))


def test_lookups_are_read_anew_for_each_batch(spark, folder):
    """A blacklist row added after the first batch counts in the second."""
    lines, listed, out, checkpoint = folder(), folder(), folder(), folder("checkpoint")
    history = spark.createDataFrame([], "nameOrig string, nameDest string, pairCount long")

    def run(tid):
        value = '{"tid":%d,"nameDest":"M1"}' % tid
        spark.createDataFrame([(value,)], "value string").write.mode("append").text(lines)
        _ended(
            jobs.start_enrichment(
                read_json_lines(spark, lines, stream=True),
                history=lambda: history,
                blacklist=lambda: read_table(spark, listed, "accountNumber string"),
                outputs=[RecordTable(out).write_records],
                checkpoint=checkpoint,
                available_now=True,
            )
        )

    overwrite_table(spark.createDataFrame([("M9",)], "accountNumber string"), listed)
    run(1)
    overwrite_table(spark.createDataFrame([("M1",)], "accountNumber string"), listed)
    run(2)
    rows = read_table(spark, out, ENRICHED_SCHEMA).select("tid", "destBlacklisted").collect()
    assert sorted(rows) == [(1, 0), (2, 1)]


@pytest.fixture
def enriched_topic(batch_result, folder):
    path = folder("topic")
    encode_messages(batch_result).repartition(4).write.parquet(path)
    return path


def _sent(spark, messages, folder, schema, fmt="parquet"):
    out = folder("out")
    _ended(jobs.start_messages(messages, MessageFolder(out, fmt), folder("checkpoint"), available_now=True))
    read = read_message_table(spark, out) if fmt == "parquet" else read_json_lines(spark, out)
    return decode_messages(read, schema)


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_rule_stream_equals_batch(spark, enriched_topic, batch_result, folder, fmt):
    source = read_message_table(spark, enriched_topic, stream=True, files_per_trigger=1)
    found = _sent(spark, jobs.rule_messages(source, sample_rules()), folder, DETECTION_SCHEMA, fmt)
    assert _rows(found) == _rows(rules.detections(batch_result, sample_rules()))
    clean = _sent(spark, jobs.clean_rule_messages(source, sample_rules()), folder, ENRICHED_SCHEMA, fmt)
    assert _rows(clean) == _rows(rules.undetected(batch_result, sample_rules()))


@pytest.mark.parametrize("name", model.MODELS)
def test_model_stream_equals_batch(spark, enriched_topic, batch_result, folder, name):
    fitted = model.train(tables.labelled_history(spark, SF_DIR), name)
    source = read_message_table(spark, enriched_topic, stream=True, files_per_trigger=2)
    scored = _sent(spark, jobs.model_messages(source, fitted), folder, DETECTION_SCHEMA)
    assert _rows(scored) == _rows(model.score(fitted, batch_result))
    clean = _sent(spark, jobs.clean_model_messages(source, fitted), folder, ENRICHED_SCHEMA)
    assert _rows(clean) == _rows(model.undetected_scored(fitted, batch_result))


def test_sink_goes_on_after_a_restart_and_starts_over_with_a_new_checkpoint(spark, folder):
    topic, table, checkpoint = folder(), folder(), folder("checkpoint")

    def send(*rows):
        frame = spark.createDataFrame(rows, DETECTION_SCHEMA)
        encode_messages(frame).coalesce(1).write.mode("append").parquet(topic)

    def run(checkpoint):
        source = read_message_table(spark, topic, stream=True, files_per_trigger=1)
        _ended(jobs.start_detection_sink(source, jobs.detection_table(table), checkpoint, available_now=True))
        return sorted(read_detections(spark, table).collect())

    send((1, 1), (1, 1), (2, 1))
    assert run(checkpoint) == [(1, 1), (2, 1)]
    send((2, 1), (3, 1))
    assert run(checkpoint) == [(1, 1), (2, 1), (3, 1)]
    assert run(checkpoint) == [(1, 1), (2, 1), (3, 1)]
    assert run(folder("checkpoint")) == [(1, 1), (2, 1), (3, 1)]


def test_a_failed_batch_is_repeated(spark, folder):
    """The batch is written, then fails: after the restart it is written again, once in effect."""
    topic, table, checkpoint = folder(), folder(), folder("checkpoint")
    for rows in ([(1, 1)], [(2, 1)], [(3, 1)]):
        frame = spark.createDataFrame(rows, DETECTION_SCHEMA)
        encode_messages(frame).coalesce(1).write.mode("append").parquet(topic)
    keep, seen = jobs.detection_table(table), []

    def failing(batch, batch_id):
        keep(batch, batch_id)
        seen.append(batch_id)
        if seen.count(1) == 1 and batch_id == 1:
            raise RuntimeError("lost after writing")

    def start(write):
        source = read_message_table(spark, topic, stream=True, files_per_trigger=1)
        return jobs.start_detection_sink(source, write, checkpoint, available_now=True)

    with pytest.raises(Exception, match="lost after writing"):
        _ended(start(failing))
    _ended(start(failing))
    assert seen == [0, 1, 1, 2]
    assert sorted(read_detections(spark, table).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_stream_source_of_the_tables(spark, folder, live):
    out = folder()
    query = (
        tables.raw_live_stream(spark, SF_DIR)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", folder("checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    _ended(query)
    assert _rows(spark.read.parquet(out).select(*live.columns)) == _rows(live.select(*map(F.col, live.columns)))


def test_a_stream_can_be_enriched_by_itself(spark, folder, past, listed, batch_result):
    """Without a job around it, a streaming frame takes the same operators."""
    out = folder()
    stream = enrich(tables.raw_live_stream(spark, SF_DIR), past, listed)
    writer = stream.writeStream.format("parquet").option("path", out)
    writer = writer.option("checkpointLocation", folder("checkpoint")).trigger(availableNow=True)
    _ended(writer.start())
    assert _rows(spark.read.parquet(out).select(*batch_result.columns)) == _rows(batch_result)


def test_a_small_batch_cuts_a_large_history_down(spark, json_files, batch_result, folder, monkeypatch):
    """A batch is joined without a search for hot keys, whatever the history's size."""

    def search(*_):
        raise AssertionError("searched for hot keys")

    monkeypatch.setattr(lookup, "hot_keys", search)
    out = folder()
    _ended(
        jobs.start_enrichment(
            read_json_lines(spark, json_files, stream=True, files_per_trigger=2),
            history=lambda: tables.raw_history(spark, SF_DIR),
            blacklist=lambda: tables.blacklist(spark, SF_DIR),
            outputs=[RecordTable(out).write_records],
            checkpoint=folder("checkpoint"),
            available_now=True,
        )
    )
    assert _rows(read_table(spark, out, ENRICHED_SCHEMA).drop("batch_id")) == _rows(batch_result)
