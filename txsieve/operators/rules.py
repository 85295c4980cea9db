"""Detection by a user's rule set: comparisons joined by AND/OR, compiled to one Spark condition."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType, StructType

# The operator, literal type and connector names of a rule table.
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "lessThan": operator.lt,
    "lessThanOrEqualTo": operator.le,
    "greaterThan": operator.gt,
    "greaterThanOrEqualTo": operator.ge,
    "equalTo": operator.eq,
    "notEqualTo": operator.ne,
}
VALUE_TYPES = ("int", "float", "string", "column")
CONNECTORS = ("AND", "OR")

RULE_TABLE_SCHEMA = (
    "rule_id int, parent_id int, ordinal int, rule_type string, connector string, "
    "attribute string, operator string, value string, value_type string"
)

_NUMBERS = {
    "int": re.compile(r"[+-]?[0-9]+"),
    "float": re.compile(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"),
}


def reads_as(kind: str, text: str) -> bool:
    """Whether a text is a plain decimal literal of the kind "int", of 32 bits, or "float"."""
    if not _NUMBERS[kind].fullmatch(text):
        return False
    return kind == "float" or -(2**31) <= int(text) < 2**31


@dataclass(frozen=True)
class Rule:
    """``attribute operator value``; with ``value_type`` "column" the value names another attribute."""

    rule_id: int
    attribute: str
    operator: str
    value: str
    value_type: str = "int"

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"rule {self.rule_id}: unknown operator {self.operator!r}")
        if self.value_type not in VALUE_TYPES:
            raise ValueError(f"rule {self.rule_id}: unknown value type {self.value_type!r}")
        if self.value is None:
            raise ValueError(f"rule {self.rule_id}: no value")
        self._literal()

    def _literal(self) -> int | float | str:
        if self.value_type not in _NUMBERS:
            return self.value
        if not reads_as(self.value_type, self.value):
            raise ValueError(f"rule {self.rule_id}: {self.value!r} is no {self.value_type}")
        return int(self.value) if self.value_type == "int" else float(self.value)

    def check(self, schema: StructType) -> None:
        """Raise unless the rule's attributes are in the schema and compare with its value."""
        left_type = _attribute_type(self, self.attribute, schema)
        if self.value_type == "column":
            right_type = _attribute_type(self, self.value, schema)
        else:
            right_type = StringType() if self.value_type == "string" else None
        wants_text = isinstance(right_type, StringType)
        if isinstance(left_type, StringType) != wants_text:
            raise ValueError(
                f"rule {self.rule_id}: {self.attribute} is {left_type.simpleString()}, "
                f"which does not compare with {self.value_type} {self.value!r}"
            )

    def to_column(self, schema: StructType) -> Column:
        self.check(schema)
        right = F.col(self.value) if self.value_type == "column" else F.lit(self._literal())
        return OPERATORS[self.operator](F.col(self.attribute), right)


@dataclass(frozen=True)
class Compound:
    """Two rules joined by AND or OR."""

    rule_id: int
    connector: str
    first: Rule | Compound
    second: Rule | Compound

    def __post_init__(self) -> None:
        if self.connector not in CONNECTORS:
            raise ValueError(f"rule {self.rule_id}: unknown connector {self.connector!r}")

    def check(self, schema: StructType) -> None:
        self.first.check(schema)
        self.second.check(schema)

    def to_column(self, schema: StructType) -> Column:
        first, second = self.first.to_column(schema), self.second.to_column(schema)
        return first & second if self.connector == "AND" else first | second


@dataclass(frozen=True)
class RuleSet:
    """Rules in order; a transaction is detected when any of them holds."""

    rules: tuple[Rule | Compound, ...]

    def __post_init__(self) -> None:
        if not self.rules:
            raise ValueError("the rule set is empty")

    @property
    def rule_count(self) -> int:
        return len(self.rules)

    def to_column(self, schema: StructType) -> Column:
        """The condition that any rule holds; NULL when none holds and some cannot be decided."""
        return _any([rule.to_column(schema) for rule in self.rules])

    @classmethod
    def from_rows(cls, rows: Iterable[Mapping[str, Any]]) -> RuleSet:
        """Build from the rows of a rule table (``RULE_TABLE_SCHEMA``)."""
        children: dict[Any, list[Mapping[str, Any]]] = {}
        ids = set()
        count = 0
        for row in rows:
            if row["rule_id"] is None:
                raise ValueError("a rule has no id")
            children.setdefault(row["parent_id"], []).append(row)
            ids.add(row["rule_id"])
            count += 1
        if len(ids) != count:
            raise ValueError("rule ids repeat")
        for siblings in children.values():
            siblings.sort(key=lambda row: (row["ordinal"], row["rule_id"]))
        used = 0

        def build(row: Mapping[str, Any]) -> Rule | Compound:
            nonlocal used
            used += 1
            rule_id, kind = row["rule_id"], row["rule_type"]
            if kind == "basic":
                return Rule(rule_id, row["attribute"], row["operator"], row["value"], row["value_type"])
            if kind == "compound":
                parts = children.get(rule_id, [])
                if len(parts) != 2:
                    raise ValueError(f"rule {rule_id}: a compound rule has two parts, not {len(parts)}")
                return Compound(rule_id, row["connector"], build(parts[0]), build(parts[1]))
            raise ValueError(f"rule {rule_id}: unknown rule type {kind!r}")

        rules = tuple(build(row) for row in children.get(None, []))
        if used != count:
            raise ValueError("some rules belong to no compound rule")
        return cls(rules)

    @classmethod
    def from_table(cls, table: DataFrame) -> RuleSet:
        """Build from a rule table read by Spark, which is job configuration and so goes whole to the driver."""
        return cls.from_rows(row.asDict() for row in table.collect())


def _attribute_type(rule: Rule, name: str, schema: StructType) -> DataType:
    if name not in schema.fieldNames():
        raise ValueError(f"rule {rule.rule_id}: unknown attribute {name!r}")
    data_type = schema[name].dataType
    if not isinstance(data_type, (NumericType, StringType)):
        raise ValueError(f"rule {rule.rule_id}: {name} is neither a number nor text")
    return data_type


def _any(conditions: list[Column]) -> Column:
    # Halving keeps the expression tree shallow for large rule sets.
    if len(conditions) == 1:
        return conditions[0]
    middle = len(conditions) // 2
    return _any(conditions[:middle]) | _any(conditions[middle:])


#: A set with more top-level rules than this is looked up in an index instead of being compiled; both find the same.
MOST_COMPILED = 300


def _judged(transactions: DataFrame, rules: RuleSet) -> tuple[DataFrame, Column]:
    """The transactions, perhaps with further columns, and the condition that some rule holds, never NULL."""
    if rules.rule_count <= MOST_COMPILED:
        return transactions, F.coalesce(rules.to_column(transactions.schema), F.lit(False))
    from txsieve.operators.rule_index import RuleIndex  # which itself needs this module

    return RuleIndex(rules, transactions.schema).matched(transactions)


def matching(transactions: DataFrame, rules: RuleSet) -> DataFrame:
    """The transactions that some rule matches, each once, all columns."""
    if rules.rule_count <= MOST_COMPILED:
        return transactions.filter(rules.to_column(transactions.schema))
    judged, condition = _judged(transactions, rules)
    return judged.filter(condition).select(*transactions.columns)


def matching_view(spark: SparkSession, name: str, rules: RuleSet) -> DataFrame:
    """The rows of a table or view, given by its name, that some rule matches."""
    return matching(spark.table(name), rules)


def detections(transactions: DataFrame, rules: RuleSet) -> DataFrame:
    """``(tid, isFraud = 1)`` for each transaction some rule matches."""
    return matching(transactions, rules).select("tid", F.lit(1).alias("isFraud"))


def undetected(transactions: DataFrame, rules: RuleSet) -> DataFrame:
    """The transactions no rule matches, undecidable ones included."""
    judged, condition = _judged(transactions, rules)
    return judged.filter(~condition).select(*transactions.columns)


def verdicts(transactions: DataFrame, rules: RuleSet) -> DataFrame:
    """``(tid, isFraud)`` for every transaction, 1 where some rule matches and 0 elsewhere."""
    judged, condition = _judged(transactions, rules)
    return judged.select("tid", condition.cast("int").alias("isFraud"))
