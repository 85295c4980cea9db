"""Jobs that end in the middle: outputs marked one by one, messages once, tables merged and models changed while a stream runs."""

import pytest
from pyspark.sql import functions as F

from txsieve.functions.messages import decode_messages, encode_messages
from txsieve.operators import model
from txsieve.operators.enrich import enrich
from txsieve.plans import tables
from txsieve.schema import DETECTION_SCHEMA, ENRICHED_SCHEMA
from txsieve.sinks.messages import MessageFolder, RecordTable
from txsieve.sinks.tables import compact_detections, overwrite_table, read_detections
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


@pytest.fixture
def lines(live, folder):
    path = folder("lines")
    encode_messages(live).select("value").repartition(3).write.text(path)
    return path


def _failing(write, at):
    """An output that fails at a batch the first time it gets it."""
    calls = []

    def output(df, batch_id):
        calls.append(batch_id)
        if batch_id == at and calls.count(at) == 1:
            raise RuntimeError("lost")
        write(df, batch_id)

    return output, calls


def _counting(write):
    calls = []

    def output(df, batch_id):
        calls.append(batch_id)
        write(df, batch_id)

    return output, calls


def test_an_output_that_finished_does_not_get_its_batch_again(spark, lines, past, listed, folder):
    first, second, bad, checkpoint = folder(), folder(), folder(), folder("checkpoint")
    whole, whole_calls = _counting(RecordTable(first).write_records)
    broken, broken_calls = _failing(RecordTable(second).write_records, 1)
    aside, aside_calls = _counting(RecordTable(bad).write_records)

    def run():
        jobs.start_enrichment(
            read_json_lines(spark, lines, stream=True, files_per_trigger=1),
            history=lambda: past,
            blacklist=lambda: listed,
            outputs=[whole, broken],
            quarantine=aside,
            checkpoint=checkpoint,
            available_now=True,
        ).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert whole_calls == [0, 1, 2]
    assert broken_calls == [0, 1, 1, 2]
    assert aside_calls == [0, 1, 2]
    stored = [sorted(read_table(spark, p, ENRICHED_SCHEMA).select("tid").collect()) for p in (first, second)]
    assert stored[0] == stored[1] and len(stored[0]) == 480


def test_messages_come_once_through_a_chain_of_live_jobs(spark, lines, live, past, listed, folder, monkeypatch):
    """The first job ends in the middle of a batch, with files already written; the second follows its folder all the time."""
    topic, checkpoint, sent, second_checkpoint = folder("topic"), folder("checkpoint"), folder("sent"), folder("checkpoint")
    poison = folder("poison")
    spark.createDataFrame([(0,)], "n int").write.parquet(poison)

    def enriched(broken):
        source = read_json_lines(spark, lines, stream=True, files_per_trigger=1)
        if broken:
            # A message of the second batch fails after others of it were written.
            late = F.col("value").contains('"tid":') & (F.rand(1) > 0.97)
            source = source.withColumn("value", F.when(late, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
        return jobs.enriched_messages(source, past, listed)

    def follow():
        source = read_message_table(spark, topic, stream=True)
        jobs.start_messages(source, MessageFolder(sent), second_checkpoint, available_now=True).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        jobs.start_messages(enriched(True), MessageFolder(topic), checkpoint, available_now=True).awaitTermination()
    # Files of the batch that failed, which no list names.
    spark.range(3).select(F.col("id").cast("string").alias("key"), F.lit("junk").alias("value")).write.mode("append").parquet(topic)
    jobs.start_messages(enriched(False), MessageFolder(topic), checkpoint, available_now=True).awaitTermination()
    follow()
    follow()
    expected = sorted(enrich(live, past, listed).collect(), key=str)
    for place in (topic, sent):
        found = decode_messages(read_message_table(spark, place), ENRICHED_SCHEMA, strict=True)
        assert sorted(found.collect(), key=str) == expected


def test_a_table_is_merged_between_batches_of_a_running_stream(spark, folder):
    topic, table = folder("topic"), folder("detections")
    rows = spark.range(400).select(F.pmod(F.col("id") * 7, F.lit(300)).alias("tid"), (F.col("id") % 3 == 0).cast("int").alias("isFraud"))
    encode_messages(rows).repartition(5).write.parquet(topic)
    write, merged = jobs.detection_table(table), []

    def write_and_merge(batch, batch_id):
        write(batch, batch_id)
        if batch_id in (1, 3):
            merged.append(compact_detections(spark, table))

    source = read_message_table(spark, topic, stream=True, files_per_trigger=1)
    jobs.start_detection_sink(source, write_and_merge, folder("checkpoint"), available_now=True).awaitTermination()
    assert merged == [1, 3]
    expected = rows.groupBy("tid").agg(F.max("isFraud").alias("isFraud"))
    assert sorted(read_detections(spark, table).collect()) == sorted(expected.collect())
    assert compact_detections(spark, table) == 4
    assert sorted(read_detections(spark, table).collect()) == sorted(expected.collect())


def test_a_model_takes_over_while_the_stream_runs(spark, live, past, listed, folder):
    """Batches before the second model keep the first one's verdicts and version, the others have the second's."""
    history = tables.labelled_history(spark, SF_DIR).persist()
    enriched = enrich(live, past, listed).persist()
    models, topic, out = folder("models"), folder("topic"), folder("verdicts")
    all_clean = model.train(history, "LOGISTIC_REGRESSION")
    all_fraud = model.train(history.withColumn("isFraud", 1 - F.col("isFraud")), "LOGISTIC_REGRESSION")
    overwrite_table(encode_messages(enriched).repartition(4), topic)
    assert model.latest_version(spark, models) is None
    assert model.publish(all_clean, spark, models) == 1
    # A model without its row is not complete yet.
    model.save(all_fraud, model.version_path(models, 9))
    write = RecordTable(out).write_records

    def write_and_publish(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 1:
            assert model.publish(all_fraud, spark, models) == 2

    source = read_message_table(spark, topic, stream=True, files_per_trigger=1)
    jobs.start_model_versions(source, models, write_and_publish, folder("checkpoint"), available_now=True).awaitTermination()
    found = spark.read.schema(f"{DETECTION_SCHEMA.simpleString()[7:-1].replace(':', ' ')}, modelVersion int, batch_id int").parquet(out).collect()
    assert len(found) == enriched.count()
    assert {(r["batch_id"], r["modelVersion"], r["isFraud"]) for r in found} == {(0, 1, 0), (1, 1, 0), (2, 2, 1), (3, 2, 1)}


def test_without_a_complete_model_scoring_fails(spark, live, past, listed, folder):
    topic = folder("topic")
    overwrite_table(encode_messages(enrich(live, past, listed).limit(3)), topic)
    source = read_message_table(spark, topic, stream=True)
    query = jobs.start_model_versions(source, folder("models"), RecordTable(folder()).write_records, folder("checkpoint"), available_now=True)
    with pytest.raises(Exception, match="holds no complete model"):
        query.awaitTermination()
