"""JSON messages (string key, string value) to records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructField, StructType

_CORRUPT = "_corrupt_record"
_END = "_end"


def parse_messages(messages: DataFrame, schema: StructType) -> DataFrame:
    """Add ``record`` (the parsed value) and ``valid`` to each message.

    A message is invalid when its value is NULL, is no JSON object, has anything but white space around its
    object, names a field twice, or gives a field a value of the wrong type. Fields outside the schema are ignored.
    """
    # Spark's parsers ignore what follows the first JSON value, and of repeated fields they keep the last. So the
    # value is parsed as the first of two elements under one name; the second holds a digest of the value, which the
    # value itself can't hold. A parse as maps, which keep repeated names, shows whether the whole text has this
    # structure: one name, two elements, the digest in its place, and no name twice in the value.
    value = F.col("value").cast("string")
    end = F.md5(value.cast("binary"))
    whole = F.concat(F.lit('{"all":['), value, F.lit(',{"' + _END + '":"'), end, F.lit('"}]}'))
    shape = StructType([StructField("all", ArrayType(schema)), StructField(_CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"}
    names = MapType(StringType(), ArrayType(MapType(StringType(), StringType())))
    both = F.struct(
        F.from_json(whole, shape, options).alias("values"),
        F.from_json(whole, names, {"allowSingleQuotes": "false"}).alias("names"),
    )
    # Exploding a one-element array keeps filters on the record above it, so each value is parsed once for its
    # values and once for its names.
    parsed = messages.select("*", F.explode(F.array(both)).alias("_parsed"))
    record = F.get(F.col("_parsed.values.all"), F.lit(0))
    # A NULL value parses to a NULL, anything else that fails fills the corrupt text.
    typed = F.col(f"_parsed.values.{_CORRUPT}").isNull() & record.isNotNull()
    valid = typed & _one_object(F.col("_parsed.names"), end)
    return parsed.select(*messages.columns, record.alias("record"), F.coalesce(valid, F.lit(False)).alias("valid"))


def _one_object(names: Column, end: Column) -> Column:
    """Whether a wrapped value is a single object without a repeated name, followed by ``end`` alone."""
    elements = F.get(F.map_values(names), F.lit(0))
    own = F.map_keys(F.get(elements, F.lit(0)))
    marks = F.map_entries(F.get(elements, F.lit(1)))
    mark = F.get(marks, F.lit(0))
    return (
        (F.map_keys(names) == F.array(F.lit("all")))
        & (F.size(elements) == 2)
        & (F.size(marks) == 1)
        & (mark["key"] == _END)
        & (mark["value"] == end)
        & (F.size(F.array_distinct(own)) == F.size(own))
    )


def decode_messages(
    messages: DataFrame, schema: StructType, fill_missing: bool = False, strict: bool = False
) -> DataFrame:
    """The records of the valid messages; ``fill_missing`` turns absent numbers into 0.

    Invalid messages are left to :func:`quarantined_messages`; if ``strict``, the first one fails the job.
    """
    return records(parse_messages(messages, schema), schema, fill_missing, strict)


def records(
    parsed: DataFrame, schema: StructType, fill_missing: bool = False, strict: bool = False
) -> DataFrame:
    """The valid records of a frame that :func:`parse_messages` made."""
    valid = F.col("valid")
    if strict:
        shown = F.coalesce(F.substring(F.col("value").cast("string"), 1, 200), F.lit("NULL"))
        refused = F.raise_error(F.concat(F.lit("invalid message: "), shown)).cast("boolean")
        valid = F.when(valid, True).otherwise(refused)
    return parsed.filter(valid).select(*[_field(f, fill_missing) for f in schema.fields])


def _field(field: StructField, fill_missing: bool) -> Column:
    column = F.col(f"record.{field.name}")
    if fill_missing and isinstance(field.dataType, NumericType):
        column = F.coalesce(column, F.lit(0).cast(field.dataType))
    return column.alias(field.name)


def quarantined_messages(messages: DataFrame, schema: StructType) -> DataFrame:
    """The messages :func:`decode_messages` leaves out, key and value as they came."""
    return parse_messages(messages, schema).filter("not valid").select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


def encode_messages(records: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """Each record as a message: ``tid`` as the key, the whole row as JSON."""
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return records.select(
        F.col("tid").cast("string").alias("key"), F.to_json(F.struct("*"), options).alias("value")
    )
