import json

import pytest

from txsieve.cli import main
from txsieve.config import JobConfig
from txsieve.functions.messages import decode_messages, encode_messages
from txsieve.operators import rules
from txsieve.operators.enrich import enrich
from txsieve.plans import tables
from txsieve.plans.sample_rules import sample_rule_table, sample_rules
from txsieve.schema import DETECTION_SCHEMA, ENRICHED_SCHEMA
from txsieve.sinks.tables import read_detections
from txsieve.sources.messages import read_json_lines, read_message_table

SF_DIR = "/root/testdata/sf0.001"


def _stream(job, source, to, checkpoint, *more):
    main([job, "--from", source, "--to", to, "--checkpoint", checkpoint, "--available-now", *more])


def test_the_whole_way(spark, folder, capsys):
    """Raw lines to enriched messages, to detections of both kinds, to tables, to a report."""
    lines, history, counts, listed = (folder(n) for n in ("lines", "history", "counts", "listed"))
    live, past = tables.raw_live(spark, SF_DIR), tables.raw_history(spark, SF_DIR)
    encode_messages(live).select("value").write.text(lines)
    past.write.parquet(history)
    tables.blacklist(spark, SF_DIR).write.parquet(listed)
    enriched = enrich(live, past, tables.blacklist(spark, SF_DIR))

    main(["pair-counts", "--history", history, "--to", counts])
    topic, other = folder("topic"), folder("topic")
    _stream("enrich", f"lines:{lines}", topic, folder(), "--pair-counts", counts, "--blacklist", listed)
    _stream("enrich", f"lines:{lines}", other, folder(), "--history", history, "--blacklist", listed,
            "--quarantine", folder())
    for made in (topic, other):
        got = decode_messages(read_message_table(spark, made), ENRICHED_SCHEMA)
        assert sorted(got.collect(), key=str) == sorted(enriched.collect(), key=str)

    rule_file = folder("rules") + ".json"
    sample_rule_table(spark).write.json(rule_file)
    found, clean = folder("found"), folder("clean")
    _stream("rules", topic, found, folder(), "--rules", rule_file)
    _stream("rules", topic, f"lines:{clean}", folder(), "--rules", rule_file, "--clean")
    assert decode_messages(read_json_lines(spark, clean), ENRICHED_SCHEMA).count() == 480 - 116

    labelled, scored = folder("labelled"), folder("scored")
    tables.labelled_history(spark, SF_DIR).write.parquet(labelled)
    _stream("score", topic, scored, folder(), "--history", labelled, "--model", "RANDOM_FOREST")
    assert decode_messages(read_message_table(spark, scored), DETECTION_SCHEMA).count() == 480

    saved, again = folder("saved"), folder("again")
    main(["train", "--history", labelled, "--model", "RANDOM_FOREST", "--to", saved])
    _stream("score", topic, again, folder(), "--model-path", saved)
    verdicts = [sorted(read_message_table(spark, made).collect()) for made in (scored, again)]
    assert verdicts[0] == verdicts[1]

    kept = folder("kept")
    _stream("keep", found, kept, folder())
    expected_rows = rules.detections(enriched, sample_rules())
    assert sorted(read_detections(spark, kept).collect()) == sorted(expected_rows.collect())

    by_rules, by_model = folder("by-rules"), folder("by-model")
    main(["screen", "--from", f"lines:{lines}", "--checkpoint", folder(), "--available-now",
          "--pair-counts", counts, "--blacklist", listed, "--rules", rule_file, "--rules-to", by_rules,
          "--model", "GBT", "--labelled", labelled, "--model-to", by_model])
    assert sorted(read_detections(spark, by_rules).collect()) == sorted(expected_rows.collect())
    assert read_detections(spark, by_model).count() == 480

    expected, pairs = folder("expected"), folder("pairs")
    tables.expected_detections(spark, SF_DIR).write.parquet(expected)
    capsys.readouterr()
    main(["evaluate", "--detections", kept, "--expected", expected, "--pairs", pairs, "--frauds-only"])
    report = capsys.readouterr().out.splitlines()
    assert report[:5] == ["Processed 480 records.", "TP: 9", "TN: 358", "FP: 107", "FN: 6"]
    assert spark.read.parquet(pairs).count() == 480


def test_bad_arguments(folder):
    for arguments in (
        [],
        ["enrich", "--from", "a", "--to", "b", "--checkpoint", "c", "--blacklist", "d"],
        ["screen", "--from", "a", "--checkpoint", "c", "--history", "d", "--blacklist", "e"],
        ["screen", "--from", "a", "--checkpoint", "c", "--history", "d", "--blacklist", "e", "--rules", "f"],
        ["score", "--from", "a", "--to", "b", "--checkpoint", "c", "--history", "d", "--model", "OTHER"],
        ["score", "--from", "a", "--to", "b", "--checkpoint", "c", "--model", "GBT"],
        ["score", "--from", "a", "--to", "b", "--checkpoint", "c", "--history", "d", "--model", "GBT", "--model-path", "e"],
    ):
        with pytest.raises(SystemExit):
            main(arguments)


def test_config_file(tmp_path):
    path = tmp_path / "job.json"
    path.write_text(json.dumps({"kafka_servers": "k:1", "fail_on_data_loss": False}))
    assert JobConfig.from_json(str(path)) == JobConfig(kafka_servers="k:1", fail_on_data_loss=False)
