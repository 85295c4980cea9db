"""The schemas every job shares."""

from __future__ import annotations

from pyspark.sql.types import FloatType, IntegerType, LongType, StringType, StructField, StructType

# The names, order and types of the columns.
RAW_SCHEMA = StructType(
    [
        StructField("tid", LongType()),
        StructField("step", IntegerType()),
        StructField("type", StringType()),
        StructField("amount", FloatType()),
        StructField("nameOrig", StringType()),
        StructField("oldBalanceOrig", FloatType()),
        StructField("newBalanceOrig", FloatType()),
        StructField("nameDest", StringType()),
        StructField("oldBalanceDest", FloatType()),
        StructField("newBalanceDest", FloatType()),
    ]
)

ENRICHED_SCHEMA = StructType(
    RAW_SCHEMA.fields
    + [
        StructField("recurrence", IntegerType()),
        StructField("destBlacklisted", IntegerType()),
        StructField("errorBalanceOrig", IntegerType()),
        StructField("errorBalanceDest", IntegerType()),
    ]
)

LABELLED_SCHEMA = StructType(ENRICHED_SCHEMA.fields + [StructField("isFraud", IntegerType())])

DETECTION_SCHEMA = StructType([StructField("tid", LongType()), StructField("isFraud", IntegerType())])

MESSAGE_SCHEMA = StructType([StructField("key", StringType()), StructField("value", StringType())])
