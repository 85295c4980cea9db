"""Rule sets as files: flat rule tables (JSON, Parquet, CSV) or nested XML documents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import SparkSession

from txsieve.operators.rules import RULE_TABLE_SCHEMA, RuleSet, reads_as

# The elements of a rule besides its id and its parts, and the columns of a rule table they go to.
_TEXT = {
    "ruleType": "rule_type",
    "connector": "connector",
    "attribute": "attribute",
    "operator": "operator",
    "value": "value",
    "valueType": "value_type",
}


def load_rule_table(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> RuleSet:
    """A rule set from a file of rule-table rows."""
    table = spark.read.schema(RULE_TABLE_SCHEMA).options(**{"mode": "FAILFAST", **options})
    return RuleSet.from_table(table.format(fmt).load(path))


def load_rule_xml(spark: SparkSession, path: str) -> RuleSet:
    """A rule set from an XML document whose root, of any name, holds ``<rule>`` elements, compound rules holding two more.

    Rules may nest to any depth. A document is job configuration and is read whole, from any store Spark
    reads. A value of any other type than int, float or string is a number if it reads as one, else it
    names an attribute.
    """
    documents = spark.read.option("wholetext", "true").text(path).take(2)
    if len(documents) != 1:
        raise ValueError(f"{path} must hold one document, found {len(documents)}")
    try:
        root = ElementTree.fromstring(documents[0]["value"].encode())
    except ElementTree.ParseError as error:
        raise ValueError(f"{path} is no XML document: {error}") from None
    return RuleSet.from_rows(_rows(root))


def _rows(root: ElementTree.Element) -> Iterator[dict[str, Any]]:
    """The document's rules as rows of a rule table."""
    waiting = [(element, None, place) for place, element in enumerate(root.findall("rule"))]
    while waiting:
        element, parent, place = waiting.pop()
        row: dict[str, Any] = {column: element.findtext(name) for name, column in _TEXT.items()}
        if row["rule_type"] == "basic":
            row["value"] = row["value"] or ""
            row["value_type"] = _value_type(row["value_type"], row["value"])
        rule_id = (element.findtext("ruleId") or "").strip()
        if not reads_as("int", rule_id):
            raise ValueError(f"rule id {rule_id!r} is no int")
        yield {**row, "rule_id": int(rule_id), "parent_id": parent, "ordinal": place}
        waiting += [(part, int(rule_id), i) for i, part in enumerate(element.findall("rule"))]


def _value_type(declared: str | None, value: str) -> str:
    if declared in ("int", "float", "string"):
        return declared
    return next((name for name in ("int", "float") if reads_as(name, value)), "column")
