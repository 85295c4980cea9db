"""A sample rule set as rule-table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txsieve.operators.rules import RULE_TABLE_SCHEMA, RuleSet

# rule_id, parent_id, ordinal, rule_type, connector, attribute, operator, value, value_type.
SAMPLE_RULES = [
    (1, None, 0, "basic", None, "newBalanceOrig", "lessThan", "200", "int"),
    (3, None, 1, "compound", "AND", None, None, None, None),
    (4, 3, 0, "basic", None, "newBalanceOrig", "lessThan", "300", "int"),
    (5, 3, 1, "basic", None, "newBalanceOrig", "greaterThan", "200", "int"),
    (6, None, 2, "basic", None, "destBlacklisted", "equalTo", "1", "int"),
    (7, None, 3, "compound", "AND", None, None, None, None),
    (8, 7, 0, "basic", None, "recurrence", "equalTo", "0", "int"),
    (9, 7, 1, "basic", None, "newBalanceOrig", "lessThan", "1000", "int"),
]


def sample_rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_RULES, RULE_TABLE_SCHEMA)


def sample_rules() -> RuleSet:
    names = [column.split()[0] for column in RULE_TABLE_SCHEMA.split(", ")]
    return RuleSet.from_rows(dict(zip(names, row)) for row in SAMPLE_RULES)
