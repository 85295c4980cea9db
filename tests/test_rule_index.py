"""The rule index against compiled conditions, and against plain comparisons where a set is too large to compile."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from txsieve.operators import rule_index, rules
from txsieve.operators.rule_index import Interval, RuleIndex, merged
from txsieve.operators.rules import Compound, Rule, RuleSet

SCHEMA = "tid int, i int, l long, f float, d double, s string, t string, _bin int, _key string"
NUMBERS = ["i", "l", "f", "d"]
OPERATORS = list(rules.OPERATORS)
VALUES = {
    "int": ["0", "1", "-3", "5", "16777217", "16777216", "2147483647", "-2147483648"],
    "float": ["0.1", "-0.0", "0.30000001192092896", "1e999", "-1e999", "5", "2.5", "1e-320"],
}


@pytest.fixture(scope="module")
def facts(spark):
    draw = random.Random(1)
    inf, nan = math.inf, math.nan
    pick = lambda *values: draw.choice([None, *values])
    rows = [
        (n, pick(0, 1, -3, 5, 16777217, 2**31 - 1, -(2**31)), pick(0, 5, 2**53 + 1, -(2**63), 16777217), pick(0.0, -0.0, 0.1, 0.3, 1.0, 5.0, 16777216.0, inf, -inf, nan),
         pick(0.0, -0.0, 0.1, 2.5, 5.0, 1e-320, inf, -inf, nan), pick("", "a", "b", "é", "A"), pick("a", "b", "c"), n % 3, "k")
        for n in range(600)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def leaf(draw, number):
    kind = draw.random()
    if kind < 0.6:
        attribute, value_type = draw.choice(NUMBERS), draw.choice(["int", "float"])
        return Rule(number, attribute, draw.choice(OPERATORS), draw.choice(VALUES[value_type]), value_type)
    if kind < 0.9:
        operator = "equalTo" if draw.random() < 0.7 else draw.choice(OPERATORS)
        return Rule(number, draw.choice("st"), operator, draw.choice(["", "a", "b", "é"]), "string")
    left, right = (draw.sample(NUMBERS, 2)) if kind < 0.97 else ("s", "t")
    return Rule(number, left, draw.choice(OPERATORS), right, "column")


def tree(draw, depth=0):
    if depth == 3 or draw.random() < 0.35 + 0.2 * depth:
        return leaf(draw, 1)
    return Compound(1, draw.choice(["AND", "AND", "OR"]), tree(draw, depth + 1), tree(draw, depth + 1))


def by_index(facts, rule_set):
    judged, condition = RuleIndex(rule_set, facts.schema).matched(facts)
    return judged.select("tid", condition.alias("hit"))


@pytest.mark.parametrize("seed", range(5))
def test_equals_the_compiled_condition(facts, seed):
    draw = random.Random(seed)
    rule_set = RuleSet(tuple(tree(draw) for _ in range(1 + seed * 3)))
    got = Counter(map(tuple, by_index(facts, rule_set).collect()))
    condition = F.coalesce(rule_set.to_column(facts.schema), F.lit(False))
    assert got == Counter(map(tuple, facts.select("tid", condition).collect()))


@pytest.mark.parametrize("attribute", NUMBERS)
def test_each_comparison_of_a_number(facts, attribute):
    """Every operator and literal by itself, NaN, infinities, both zeros and missing values included."""
    shown = {}
    expected = []
    for value_type, values in VALUES.items():
        for operator in OPERATORS:
            for value in values:
                rule = RuleSet((Rule(1, attribute, operator, value, value_type),))
                name = f"c{len(shown)}"
                shown[name] = rule
                expected.append(F.coalesce(rule.to_column(facts.schema), F.lit(False)).alias(name))
    wanted = facts.select("tid", *expected).collect()
    frame, columns = facts, []
    for name, rule in list(shown.items())[::16]:
        frame, condition = RuleIndex(rule, facts.schema).matched(frame)
        columns.append(condition.alias(name))
    got = {row["tid"]: row for row in frame.select("tid", *columns).collect()}
    for row in wanted:
        for name in list(shown)[::16]:
            assert got[row["tid"]][name] == row[name], shown[name]


def test_large_sets_take_the_index_everywhere(facts, monkeypatch):
    draw = random.Random(40)
    rule_set = RuleSet(tuple(tree(draw) for _ in range(5)))
    wanted = [f(facts, rule_set) for f in (rules.matching, rules.undetected, rules.verdicts, rules.detections)]
    wanted = [(df.columns, Counter(map(str, df.collect()))) for df in wanted]
    monkeypatch.setattr(rules, "MOST_COMPILED", 0)
    monkeypatch.setattr(rule_index, "INDEX_SIZE", 2)
    got = [f(facts, rule_set) for f in (rules.matching, rules.undetected, rules.verdicts, rules.detections)]
    assert [(df.columns, Counter(map(str, df.collect()))) for df in got] == wanted


def test_a_rule_that_fits_no_attribute_is_refused(facts):
    with pytest.raises(ValueError, match="unknown attribute"):
        RuleIndex(RuleSet((Rule(1, "nope", "lessThan", "1"),)), facts.schema)
    with pytest.raises(ValueError, match="does not compare"):
        RuleIndex(RuleSet((Rule(1, "s", "lessThan", "1"),)), facts.schema)


def test_intervals_are_merged():
    a, b = Interval(1.0, False, 3.0, True), Interval(3.0, False, 4.0, False)
    assert merged([b, a]) == [Interval(1.0, False, 4.0, False)]
    assert merged([a, Interval(3.0, True, 4.0, False)]) == [a, Interval(3.0, True, 4.0, False)]
    assert merged([Interval(low=5.0), Interval(high=2.0), Interval(high=7.0, below=True)]) == [Interval()]
    assert merged([Interval(1.0, False, 9.0, False), Interval(2.0, False, 3.0, False)]) == [Interval(1.0, False, 9.0, False)]
    assert merged([]) == []


def test_thresholds_of_one_attribute_become_one_interval(facts):
    """Ten thousand rules of one attribute cost as much as one."""
    many = RuleSet(tuple(Rule(n, "d", "lessThan", str(n / 1000), "float") for n in range(10_000)))
    index = RuleIndex(many, facts.schema)
    assert len(index.boxes) == 1 and index.boxes[0].numbers == {"d": Interval(high=9.999, below=True)}


def _random_rules(n, seed):
    """Mostly compounds that hold for few rows, over several attributes."""
    draw = random.Random(seed)
    out, plain = [], []
    for k in range(n):
        kind = k % 4
        if kind == 0:
            low = draw.uniform(0, 1000)
            out.append(Compound(k, "AND", Rule(-1, "d", "greaterThan", repr(low), "float"), Rule(-1, "d", "lessThan", repr(low + 0.001), "float")))
            plain.append(("range", low, low + 0.001))
        elif kind == 1:
            name, high = f"n{draw.randrange(5000)}", draw.randrange(200)
            out.append(Compound(k, "AND", Rule(-1, "s", "equalTo", name, "string"), Rule(-1, "i", "lessThan", str(high))))
            plain.append(("name", name, high))
        elif kind == 2:
            low, high = draw.randrange(1000), draw.uniform(0, 2)
            out.append(Compound(k, "AND", Rule(-1, "i", "greaterThanOrEqualTo", str(low)), Rule(-1, "d", "lessThan", repr(high), "float")))
            plain.append(("corner", low, high))
        else:
            out.append(Rule(k, "l", "equalTo", str(draw.randrange(10**6)), "int"))
            plain.append(("id", int(out[-1].value)))
    return RuleSet(tuple(out)), plain


def _plain(row, plain):
    for rule in plain:
        kind = rule[0]
        if kind == "range" and rule[1] < row["d"] < rule[2]:
            return True
        if kind == "name" and row["s"] == rule[1] and row["i"] < rule[2]:
            return True
        if kind == "corner" and row["i"] >= rule[1] and row["d"] < rule[2]:
            return True
        if kind == "id" and row["l"] == rule[1]:
            return True
    return False


def test_twenty_thousand_rules(spark):
    draw = random.Random(5)
    rows = [(n, draw.randrange(1000), draw.randrange(10**6), 0.0, draw.uniform(0, 1000), f"n{draw.randrange(20_000)}", None, 0, None) for n in range(1500)]
    frame = spark.createDataFrame(rows, SCHEMA)
    large, plain = _random_rules(20_000, 6)
    small, _ = _random_rules(rules.MOST_COMPILED + 20, 7)
    rules.verdicts(frame, small).collect()
    took = {}
    for name, rule_set in (("small", small), ("large", large)):
        judged, condition = RuleIndex(rule_set, frame.schema).matched(frame)
        start = time.perf_counter()
        got = {r["tid"]: r["hit"] for r in judged.select("tid", condition.alias("hit")).collect()}
        took[name] = time.perf_counter() - start
    # Transactions meet the rules of their bins alone, so sixty times as many rules take about as long.
    assert took["large"] < 4 * took["small"] + 2
    assert got == {row["tid"]: _plain(row, plain) for row in frame.collect()}
    assert 20 < sum(got.values()) < 1400
