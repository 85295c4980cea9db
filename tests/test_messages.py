import pytest

from txsieve.functions.messages import (
    decode_messages,
    encode_messages,
    parse_messages,
    quarantined_messages,
)
from txsieve.schema import DETECTION_SCHEMA, ENRICHED_SCHEMA, MESSAGE_SCHEMA, RAW_SCHEMA

VALID = [
    '{"tid":5}',
    '{"tid":6,"isFraud":1}',
    "{}",
    '{"tid":null}',
    '{"TID":3}',
    ' {"tid":2} ',
    '{"tid":1,"amount":5}',
    '{"tid":3000000000}',
    '{"tid":1,"_corrupt_record":"x"}',
    '{"tid":1,"amount":"NaN"}',
]
INVALID = [
    '{"tid":"12"}',
    '{"tid":12.7}',
    '{"tid":99999999999999999999}',
    '{"tid":1,"amount":"3.5"}',
    "{'tid':1}",
    "{tid:1}",
    '{"tid":01}',
    '{"tid":true}',
    "garbage",
    '{"tid":1',
    '[{"tid":1}]',
    "null",
    "12",
    "",
    None,
]


TRAILING = [
    '{"tid":2} {"tid":3}',
    '{"tid":2}{"tid":3}',
    '{"tid":2},{"tid":3}',
    '{"tid":2}\n{"tid":3}\n',
    '{"tid":2} garbage',
    '{"tid":2} null',
    '{"tid":2},',
    '{"tid":2},"tid":3',
    '{"tid":2}}',
    '{"tid":2}]',
    '{"tid":2}]}',
    '{"tid":2},{"_end":"x"}]}',
    '{"tid":2} /* x */',
    '{"tid":2}\xa0',
    '{"tid":2}\x00',
    '"" {"tid":2}',
    '{"tid":1,"isFraud":1}],"all":[{"tid":2,"isFraud":0}',
    '{"tid":1}] , "all":[ {"tid":2}',
    '{"tid":1}],"x":[{"tid":2}',
    '{"tid":1}],"all":[{"tid":2},{"_end":"x"}],"all":[{"tid":3}',
    '{"tid":1}],"all":null,"x":[{"tid":2}',
    '{"tid":1}],"\\u0061ll":[{"tid":2}',
    '{"tid":1},{"tid":2}],"all":[{"tid":3}',
    '{"tid":2} {"tid":',
]
REPEATED = [
    '{"tid":1,"tid":3}',
    '{"tid":1,"tid":1}',
    '{"tid":1,"isFraud":0,"isFraud":1}',
    '{"tid":1,"x":1,"x":2}',
    '{"tid":1,"\\u0074id":3}',
    '{"tid":1,"tid":null}',
]
WHOLE = [
    '{"tid":2}\n\t\r ',
    '{"tid":1,"amount":NaN}',
    '{"tid":1,"x":Infinity}',
    '{"tid":1,"x":[{"y":"}] {"}]}',
    '{"tid":1,"_end":5,"all":[]}',
    '{"tid":1,"x":{"y":1,"y":2}}',
]


@pytest.fixture
def messages(spark):
    return lambda *values: spark.createDataFrame([("k", v) for v in values], MESSAGE_SCHEMA)


def test_valid_and_invalid(messages):
    rows = parse_messages(messages(*VALID, *INVALID), RAW_SCHEMA).select("value", "valid").collect()
    assert {r["value"] for r in rows if r["valid"]} == set(VALID)
    assert {r["value"] for r in rows if not r["valid"]} == set(INVALID)


def test_every_message_is_either_decoded_or_quarantined(messages):
    given = messages(*VALID, *INVALID)
    assert decode_messages(given, RAW_SCHEMA).count() == len(VALID)
    out = quarantined_messages(given, RAW_SCHEMA)
    assert out.columns == ["key", "value"]
    assert {r["value"] for r in out.collect()} == set(INVALID)


def test_nothing_may_follow_the_object(messages):
    given = messages(*TRAILING, *WHOLE)
    assert {r["value"] for r in quarantined_messages(given, RAW_SCHEMA).collect()} == set(TRAILING)
    assert sorted(r["tid"] for r in decode_messages(given, RAW_SCHEMA).collect()) == [1, 1, 1, 1, 1, 2]
    with pytest.raises(Exception, match="invalid message: "):
        decode_messages(messages(TRAILING[0]), RAW_SCHEMA, strict=True).collect()


def test_no_field_may_be_named_twice(messages):
    given = messages(*REPEATED, *WHOLE)
    assert {r["value"] for r in quarantined_messages(given, RAW_SCHEMA).collect()} == set(REPEATED)
    for value in REPEATED:
        with pytest.raises(Exception, match="invalid message: "):
            decode_messages(messages(value), DETECTION_SCHEMA, strict=True).collect()


def test_the_value_cannot_know_its_own_digest(messages):
    """A value that ends the array itself and leaves a second one of its own making is invalid, whatever it puts there."""
    for inner in ('{"tid":1},{"_end":"%s"}' % ("0" * 32), '{"tid":1},{"_end":null}', '{"tid":1},{}', '{"tid":1},null'):
        assert quarantined_messages(messages(inner, inner + '],"all":[' + inner), RAW_SCHEMA).count() == 2


def test_strict_decoding_fails_on_an_invalid_message(messages):
    assert decode_messages(messages(*VALID), RAW_SCHEMA, strict=True).count() == len(VALID)
    with pytest.raises(Exception, match="invalid message: garbage"):
        decode_messages(messages(*VALID, "garbage"), RAW_SCHEMA, strict=True).collect()


def test_missing_numbers(messages):
    given = messages('{"tid":5}')
    plain = decode_messages(given, RAW_SCHEMA).first()
    assert (plain["tid"], plain["step"], plain["amount"]) == (5, None, None)
    filled = decode_messages(given, RAW_SCHEMA, fill_missing=True).first()
    assert (filled["step"], filled["amount"], filled["type"], filled["nameOrig"]) == (0, 0.0, None, None)


def test_binary_values_as_kafka_gives_them(spark):
    df = spark.createDataFrame([(b"1", b'{"tid":1,"isFraud":1}'), (None, b"x")], "key binary, value binary")
    assert decode_messages(df, DETECTION_SCHEMA).collect() == [(1, 1)]
    assert quarantined_messages(df, DETECTION_SCHEMA).collect() == [(None, "x")]


def test_round_trip(enriched):
    df = enriched({"tid": 1, "amount": 0.1}, {"tid": 2, "type": 'quote " and \\', "amount": 1e-7}, {"type": None})
    assert sorted(decode_messages(encode_messages(df), ENRICHED_SCHEMA).collect(), key=str) == sorted(
        df.collect(), key=str
    )


def test_encode(spark):
    df = spark.createDataFrame([(7, None)], DETECTION_SCHEMA)
    assert encode_messages(df).first() == ("7", '{"tid":7}')
    assert encode_messages(df, keep_nulls=True).first() == ("7", '{"tid":7,"isFraud":null}')


def test_each_value_is_parsed_once_for_its_values_and_once_for_its_names(messages, capsys):
    decode_messages(messages(*VALID), RAW_SCHEMA, fill_missing=True).explain()
    plan = capsys.readouterr().out
    assert plan.count("from_json(StructField(all") == 1
    assert plan.count("from_json(") == 2
