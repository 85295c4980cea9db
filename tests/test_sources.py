import os
import time
import json

import pytest

from txsieve.config import JobConfig
from txsieve.operators.rules import Compound, Rule
from txsieve.plans.sample_rules import sample_rule_table, sample_rules
from txsieve.sinks.messages import kafka_write_options
from txsieve.sources.messages import kafka_read_options, read_json_lines
from txsieve.sources.rules import load_rule_table, load_rule_xml
from txsieve.sources.tables import jdbc_options, jdbc_read_options


def test_kafka_options():
    config = JobConfig(kafka_servers="a:1,b:2", fail_on_data_loss=False)
    assert kafka_read_options(config, "t", max_per_trigger=9) == {
        "kafka.bootstrap.servers": "a:1,b:2",
        "subscribe": "t",
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": "9",
    }
    assert kafka_read_options(JobConfig(), "t", starting="latest")["startingOffsets"] == "latest"
    assert kafka_read_options(JobConfig(), "t")["failOnDataLoss"] == "true"
    assert kafka_write_options(config, "t") == {"kafka.bootstrap.servers": "a:1,b:2", "topic": "t"}
    with pytest.raises(ValueError):
        kafka_read_options(JobConfig(kafka_servers=""), "t")


def test_jdbc_options():
    config = JobConfig(jdbc_url="jdbc:x", jdbc_driver="d", jdbc_user="u", jdbc_password="secret")
    assert jdbc_options(config, "t")["dbtable"] == "t"
    assert "secret" not in repr(config)
    split = jdbc_read_options(config, "t", partition_column="tid", lower=0, upper=100, partitions=4)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "tid",
        "0",
        "100",
        "4",
    )
    assert "partitionColumn" not in jdbc_read_options(config, "t")
    with pytest.raises(ValueError):
        jdbc_read_options(config, "t", partition_column="tid", lower=5, upper=5, partitions=4)
    with pytest.raises(ValueError):
        jdbc_options(JobConfig(), "t")


def test_json_lines(spark, folder):
    path = folder()
    spark.createDataFrame([('{"tid":1}',), ("x",)], "value string").write.text(path)
    assert set(read_json_lines(spark, path).collect()) == {(None, "x"), (None, '{"tid":1}')}


def test_rule_table_files(spark, folder):
    for fmt in ("json", "parquet", "csv"):
        path = folder()
        sample_rule_table(spark).write.format(fmt).save(path)
        assert load_rule_table(spark, path, fmt) == sample_rules()


def _basic(rule_id, value="1", kind="int", attribute="amount"):
    return (
        f"<rule><ruleId>{rule_id}</ruleId><ruleType>basic</ruleType><attribute>{attribute}</attribute>"
        f"<operator>lessThan</operator><value>{value}</value><valueType>{kind}</valueType>"
        "<value2>0</value2><value2Type>none</value2Type></rule>"
    )


def _compound(rule_id, *parts, connector="AND"):
    # The connector comes after the first part: the order of elements does not matter.
    return (
        f"<rule><ruleId>{rule_id}</ruleId><ruleType>compound</ruleType>{parts[0]}"
        f"<connector>{connector}</connector>{''.join(parts[1:])}</rule>"
    )


@pytest.fixture
def xml(spark, folder):
    def load(*rules):
        path = folder("rules")
        document = '<?xml version="1.0"?>' + "<ruleset>" + "".join(rules) + "</ruleset>"
        spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(path)
        return load_rule_xml(spark, path)

    return load


def test_xml_rules(xml):
    loaded = xml(_basic(1), _compound(2, _compound(3, _basic(4), _basic(5), connector="OR"), _basic(6)))
    part = {i: Rule(i, "amount", "lessThan", "1", "int") for i in (1, 4, 5, 6)}
    assert loaded.rules == (part[1], Compound(2, "AND", Compound(3, "OR", part[4], part[5]), part[6]))


def test_xml_value_types(xml):
    kinds = [("1.5", "float"), ("2", "none"), ("2.5", "double"), ("step", "none"), (" a ", "string")]
    loaded = xml(*[_basic(i, value, kind) for i, (value, kind) in enumerate(kinds)])
    assert [(r.value, r.value_type) for r in loaded.rules] == [
        ("1.5", "float"),
        ("2", "int"),
        ("2.5", "float"),
        ("step", "column"),
        (" a ", "string"),
    ]


def test_bad_xml(xml):
    refused = [[], [_compound(1, _basic(2))], [_basic("x")], [_basic("")], [_basic(1), _basic(1)]]
    for rules in [*refused, [_basic(1, value="abc")], ["<rule>"]]:
        with pytest.raises(ValueError):
            xml(*rules)


def test_deep_xml(xml):
    deep, expected = _basic(1), Rule(1, "amount", "lessThan", "1", "int")
    for i in range(40):
        deep = _compound(10 + i, deep, _basic(100 + i), connector=("AND", "OR")[i % 2])
        expected = Compound(10 + i, ("AND", "OR")[i % 2], expected, Rule(100 + i, "amount", "lessThan", "1", "int"))
    assert xml(deep).rules == (expected,)


def test_any_root_element(spark, folder):
    path = folder("rules")
    document = f'<?xml version="1.0" encoding="UTF-8"?><other>{_basic(1)}</other>'
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(path)
    assert load_rule_xml(spark, path).rules == (Rule(1, "amount", "lessThan", "1", "int"),)


def test_rule_json_fields_are_checked(spark, folder):
    path = folder()
    row = {"rule_id": "not a number", "rule_type": "basic"}
    spark.createDataFrame([(json.dumps(row),)], "value string").write.text(path)
    with pytest.raises(Exception):
        load_rule_table(spark, path)


def test_old_files_are_read(spark, folder):
    lines, out = folder("lines"), folder("out")
    os.makedirs(lines)
    for name, age in (("old", 30 * 86_400), ("new", 0)):
        with open(f"{lines}/{name}.json", "w") as file:
            file.write('{"tid":1}\n')
        os.utime(f"{lines}/{name}.json", (time.time() - age,) * 2)
    stream = read_json_lines(spark, lines, stream=True, files_per_trigger=1)
    query = stream.writeStream.option("path", out).option("checkpointLocation", folder("state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.schema(stream.schema).parquet(out).count() == 2
