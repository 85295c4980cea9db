import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txsieve.operators.rules import (
    OPERATORS,
    Compound,
    Rule,
    RuleSet,
    detections,
    matching,
    undetected,
    verdicts,
)
from txsieve.plans.sample_rules import sample_rule_table, sample_rules
from txsieve.schema import ENRICHED_SCHEMA


def _tids(df):
    return sorted(r["tid"] for r in df.select("tid").collect())


def _one(rule):
    return RuleSet((rule,))


@pytest.mark.parametrize(
    "operator, tids",
    [
        ("lessThan", [1]),
        ("lessThanOrEqualTo", [1, 2]),
        ("greaterThan", [3]),
        ("greaterThanOrEqualTo", [2, 3]),
        ("equalTo", [2]),
        ("notEqualTo", [1, 3]),
    ],
)
def test_operators(enriched, operator, tids):
    df = enriched(*[{"tid": i, "step": s} for i, s in ((1, 9), (2, 10), (3, 11), (4, None))])
    assert _tids(matching(df, _one(Rule(1, "step", operator, "10")))) == tids


def test_string_literal_with_a_quote(enriched):
    df = enriched({"tid": 1, "type": "O'Brien"}, {"tid": 2, "type": "x' OR '1'='1"}, {"tid": 3})
    assert _tids(matching(df, _one(Rule(1, "type", "equalTo", "O'Brien", "string")))) == [1]
    assert _tids(matching(df, _one(Rule(1, "type", "equalTo", "x' OR '1'='1", "string")))) == [2]


def test_float_literal_compares_as_double(enriched):
    df = enriched({"tid": 1, "amount": 0.1}, {"tid": 2, "amount": 0.5})
    assert _tids(matching(df, _one(Rule(1, "amount", "equalTo", "0.1", "float")))) == []
    assert _tids(matching(df, _one(Rule(1, "amount", "equalTo", "0.5", "float")))) == [2]


def test_column_comparison(enriched):
    df = enriched({"tid": 1, "newBalanceDest": 5000.0}, {"tid": 2})
    rule = Rule(1, "newBalanceDest", "greaterThan", "newBalanceOrig", "column")
    assert _tids(matching(df, _one(rule))) == [1]
    text = Rule(1, "nameOrig", "notEqualTo", "nameDest", "column")
    assert _tids(matching(df, _one(text))) == [1, 2]


def test_nested_first_and_second(enriched):
    df = enriched(
        *[
            {"tid": i, "step": s, "recurrence": r, "destBlacklisted": b}
            for i, (s, r, b) in enumerate(itertools.product((0, 1), repeat=3))
        ]
    )
    a, b, c = (Rule(i, n, "equalTo", "1") for i, n in enumerate(("step", "recurrence", "destBlacklisted")))
    first = Compound(9, "AND", Compound(8, "OR", a, b), c)
    second = Compound(9, "OR", a, Compound(8, "AND", b, c))
    assert _tids(matching(df, _one(first))) == [3, 5, 7]
    assert _tids(matching(df, _one(second))) == [3, 4, 5, 6, 7]


def test_sample_rules_at_their_bounds(enriched):
    df = enriched(
        {"tid": 1, "newBalanceOrig": 200.0},
        {"tid": 2, "newBalanceOrig": 199.0},
        {"tid": 3, "newBalanceOrig": 201.0},
        {"tid": 4, "newBalanceOrig": 300.0},
        {"tid": 5, "destBlacklisted": 1},
        {"tid": 6, "newBalanceOrig": 999.0, "recurrence": 0},
        {"tid": 7, "newBalanceOrig": 1000.0, "recurrence": 0},
        {"tid": 8, "newBalanceOrig": None},
        {"tid": 9, "newBalanceOrig": None, "destBlacklisted": 1},
    )
    found = [2, 3, 5, 6, 9]
    assert _tids(detections(df, sample_rules())) == found
    assert detections(df, sample_rules()).columns == ["tid", "isFraud"]
    assert _tids(undetected(df, sample_rules())) == [1, 4, 7, 8]
    assert {r["tid"] for r in verdicts(df, sample_rules()).collect() if r["isFraud"] == 1} == set(found)
    assert verdicts(df, sample_rules()).count() == 9


def test_copies_stay(enriched):
    df = enriched({"tid": 1, "newBalanceOrig": 0.0}, {"tid": 1, "newBalanceOrig": 0.0}, {"tid": 2}, {"tid": 2})
    assert _tids(detections(df, sample_rules())) == [1, 1]
    assert _tids(undetected(df, sample_rules())) == [2, 2]


def test_rule_table(spark):
    loaded = RuleSet.from_table(sample_rule_table(spark).orderBy(F.desc("rule_id")))
    assert loaded == sample_rules()
    assert loaded.rule_count == 4


GOOD = {
    "rule_id": 1,
    "parent_id": None,
    "ordinal": 0,
    "rule_type": "basic",
    "connector": None,
    "attribute": "amount",
    "operator": "lessThan",
    "value": "1",
    "value_type": "int",
}


@pytest.mark.parametrize(
    "change",
    [
        {"operator": "between"},
        {"value_type": "date"},
        {"value": "1.5"},
        {"value": "abc", "value_type": "float"},
        {"value": "1_000"},
        {"value": "2147483648"},
        {"value": "nan", "value_type": "float"},
        {"rule_id": None},
        {"value": None},
        {"rule_type": "other"},
        {"rule_type": "compound", "connector": "AND"},
        {"parent_id": 77},
        {"attribute": "amount; DROP TABLE x"},
        {"value_type": "string"},
        {"attribute": "type"},
        {"value": "type", "value_type": "column"},
        {"value": "missing", "value_type": "column"},
    ],
)
def test_bad_rules_are_refused(change):
    with pytest.raises(ValueError):
        RuleSet.from_rows([{**GOOD, **change}]).to_column(ENRICHED_SCHEMA)


def test_bad_sets_are_refused():
    part = Rule(1, "amount", "lessThan", "1")
    with pytest.raises(ValueError):
        RuleSet(())
    with pytest.raises(ValueError):
        RuleSet.from_rows([])
    with pytest.raises(ValueError):
        RuleSet.from_rows([GOOD, GOOD])
    with pytest.raises(ValueError):
        Compound(1, "XOR", part, part)


def test_large_sets_compile(enriched):
    rules = RuleSet(tuple(Rule(i, "step", "equalTo", str(i)) for i in range(1500)))
    assert _tids(matching(enriched({"tid": 1, "step": 1499}, {"tid": 2, "step": 1500}), rules)) == [1]


def test_large_rule_table_loads(spark):
    row = "CAST(id AS INT) AS rule_id, CAST(NULL AS INT) AS parent_id, CAST(id AS INT) AS ordinal, 'basic' AS rule_type"
    rest = "NULL AS connector, 'step' AS attribute, 'equalTo' AS operator, CAST(id AS STRING) AS value, 'int' AS value_type"
    loaded = RuleSet.from_table(spark.range(20_000).selectExpr(*f"{row}, {rest}".split(", ")))
    assert loaded.rule_count == 20_000
    assert [rule.value for rule in loaded.rules] == [str(i) for i in range(20_000)]


# Random rule trees against a plain evaluation with SQL's three-valued logic.

_COMPARE = {
    "lessThan": lambda x, y: x < y,
    "lessThanOrEqualTo": lambda x, y: x <= y,
    "greaterThan": lambda x, y: x > y,
    "greaterThanOrEqualTo": lambda x, y: x >= y,
    "equalTo": lambda x, y: x == y,
    "notEqualTo": lambda x, y: x != y,
}


def _evaluate(rule, row):
    if isinstance(rule, Rule):
        left = row[rule.attribute]
        right = row[rule.value] if rule.value_type == "column" else int(rule.value)
        return None if left is None or right is None else _COMPARE[rule.operator](left, right)
    sides = (_evaluate(rule.first, row), _evaluate(rule.second, row))
    decisive = rule.connector == "OR"
    if decisive in sides:
        return decisive
    return None if None in sides else not decisive


_names = st.sampled_from(["step", "recurrence", "destBlacklisted"])
_basic = st.one_of(
    st.builds(Rule, st.just(1), _names, st.sampled_from(list(OPERATORS)), st.integers(0, 2).map(str)),
    st.builds(Rule, st.just(1), _names, st.sampled_from(list(OPERATORS)), _names, st.just("column")),
)
_trees = st.recursive(
    _basic, lambda t: st.builds(Compound, st.just(1), st.sampled_from(["AND", "OR"]), t, t), max_leaves=8
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(sets=st.lists(st.lists(_trees, min_size=1, max_size=3), min_size=1, max_size=4))
def test_compiler_agrees_with_plain_evaluation(enriched, sets):
    values = (None, 0, 1, 2)
    rows = [
        {"tid": i, "step": s, "recurrence": r, "destBlacklisted": b}
        for i, (s, r, b) in enumerate(itertools.product(values, repeat=3))
    ]
    df = enriched(*rows)
    compiled = [RuleSet(tuple(rules)).to_column(df.schema) for rules in sets]
    got = {r["tid"]: tuple(r)[1:] for r in df.select("tid", *compiled).collect()}
    for row in rows:
        for rules, outcome in zip(sets, got[row["tid"]]):
            parts = [_evaluate(rule, row) for rule in rules]
            expected = True if True in parts else None if None in parts else False
            assert outcome == expected
