"""Large rule sets as an index: comparisons become intervals in range bins, and a transaction meets only the rules of its bins.

A set of a few hundred rules compiles to one condition. Thousands don't, and would be tried one by one for every transaction. Here
the set is taken apart into conjunctions, single intervals of one attribute are merged, and every other conjunction is filed under one of
its parts: a text it asks for, or the range bins of an interval. A transaction finds the conjunctions of its own texts and bins by joins
on unique keys, which add no rows, and tries those alone.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from txsieve.operators.rules import Compound, Rule, RuleSet

#: Cut points of an attribute's bins, and how many bins make one of the coarse bins that long intervals are filed under.
MOST_CUTS = 255
COARSE = 16
#: A rule with more alternatives than this is compiled as it is; so is every rule without a part to file it under.
MOST_ALTERNATIVES = 64
#: Conjunctions in one index, which bounds what is broadcast; a larger set makes several.
INDEX_SIZE = 50_000

_NUMBERS = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)
_BOX = (
    "struct<numbers:array<struct<a:int,low:double,above:boolean,high:double,below:boolean>>,"
    "texts:array<struct<a:int,text:string>>,flags:array<int>>"
)


@dataclass(frozen=True)
class Interval:
    """Numbers from ``low`` (None: all small ones) to ``high`` (None: all large ones, and NaN, which is above all)."""

    low: float | None = None
    above: bool = False  # the low end itself is left out
    high: float | None = None
    below: bool = False  # the high end itself is left out

    def meet(self, other: Interval) -> Interval:
        lows = [(i.low, i.above) for i in (self, other) if i.low is not None]
        highs = [(i.high, not i.below) for i in (self, other) if i.high is not None]
        low, above = max(lows, default=(None, False))
        high, closed = min(highs, default=(None, True))
        return Interval(low, above, high, not closed)

    def empty(self) -> bool:
        if self.low is None or self.high is None:
            return False
        return self.low > self.high or self.low == self.high and (self.above or self.below)

    def reaches(self, other: Interval) -> bool:
        """Whether an interval that starts no earlier begins before this one's end or right at it, so that both make one."""
        if self.high is None or other.low is None:
            return True
        return other.low < self.high or other.low == self.high and not (self.below and other.above)


@dataclass
class Box:
    """A conjunction: an interval for some number attributes, a text for some text attributes, and compiled comparisons by their number."""

    numbers: dict[str, Interval] = field(default_factory=dict)
    texts: dict[str, str] = field(default_factory=dict)
    flags: set[int] = field(default_factory=set)
    impossible: bool = False


_SHAPES = {
    "lessThan": lambda v: [Interval(high=v, below=True)],
    "lessThanOrEqualTo": lambda v: [Interval(high=v)],
    "greaterThan": lambda v: [Interval(low=v, above=True)],
    "greaterThanOrEqualTo": lambda v: [Interval(low=v)],
    "equalTo": lambda v: [Interval(v, False, v, False)],
    "notEqualTo": lambda v: [Interval(high=v, below=True), Interval(low=v, above=True)],
}


def merged(intervals: Sequence[Interval]) -> list[Interval]:
    """The same numbers as disjoint intervals in order."""
    out: list[Interval] = []
    for one in sorted(intervals, key=lambda i: (i.low is not None, i.low or 0.0, i.above)):
        if out and out[-1].reaches(one):
            last = out[-1]
            if last.high is not None and (one.high is None or (one.high, not one.below) > (last.high, not last.below)):
                out[-1] = Interval(last.low, last.above, one.high, one.below)
        else:
            out.append(one)
    return out


def _alternatives(rule: Rule | Compound) -> list[list[Rule]] | None:
    """The rule as alternatives of comparisons that must all hold, or None where there are too many."""
    if isinstance(rule, Rule):
        return [[rule]]
    first, second = _alternatives(rule.first), _alternatives(rule.second)
    if first is None or second is None:
        return None
    out = first + second if rule.connector == "OR" else [a + b for a in first for b in second]
    return out if len(out) <= MOST_ALTERNATIVES else None


class RuleIndex:
    """A rule set over transactions of one schema, for :meth:`matched`."""

    def __init__(self, rules: RuleSet, schema: StructType):
        self.schema = schema
        self.flags: dict[tuple[str, str, str, str], Column] = {}
        self.compiled: list[Column] = []
        boxes: list[Box] = []
        for rule in rules.rules:
            rule.check(schema)
            found = list(self._boxes(rule))
            if any(box is None or not (box.impossible or box.numbers or box.texts) for box in found):
                self.compiled.append(rule.to_column(schema))
            else:
                boxes += [box for box in found if not box.impossible]
        self.boxes = self._merged(boxes)
        self.attributes = sorted({a for box in self.boxes for a in box.numbers})
        self.texts = sorted({a for box in self.boxes for a in box.texts})
        self.cuts = {a: self._cuts(a) for a in self.attributes}

    def _boxes(self, rule: Rule | Compound) -> Iterator[Box | None]:
        alternatives = _alternatives(rule)
        if alternatives is None:
            yield None
            return
        for leaves in alternatives:
            boxes = [Box()]
            for leaf in leaves:
                boxes = [b for box in boxes for b in self._with(box, leaf)]
                if len(boxes) > MOST_ALTERNATIVES:
                    yield None
                    return
            yield from boxes

    def _with(self, box: Box, leaf: Rule) -> list[Box]:
        """The box with one more comparison, an inequality of numbers as two."""
        kind = self.schema[leaf.attribute].dataType
        if leaf.value_type in ("int", "float") and isinstance(kind, _NUMBERS):
            value = float(leaf.value)
            out = []
            for interval in _SHAPES[leaf.operator](value):
                met = box.numbers.get(leaf.attribute, Interval()).meet(interval)
                out.append(Box(box.numbers | {leaf.attribute: met}, box.texts, box.flags, box.impossible or met.empty()))
            return out
        if leaf.value_type == "string" and leaf.operator == "equalTo":
            other = box.texts.get(leaf.attribute, leaf.value)
            return [Box(box.numbers, box.texts | {leaf.attribute: leaf.value}, box.flags, box.impossible or other != leaf.value)]
        key = (leaf.attribute, leaf.operator, leaf.value, leaf.value_type)
        self.flags.setdefault(key, leaf.to_column(self.schema))
        return [Box(box.numbers, box.texts, box.flags | {list(self.flags).index(key)}, box.impossible)]

    @staticmethod
    def _merged(boxes: list[Box]) -> list[Box]:
        single: dict[str, list[Interval]] = defaultdict(list)
        others: dict[tuple, Box] = {}
        for box in boxes:
            if len(box.numbers) == 1 and not box.texts and not box.flags:
                ((attribute, interval),) = box.numbers.items()
                single[attribute].append(interval)
            else:
                key = (tuple(sorted(box.numbers.items(), key=lambda x: x[0])), tuple(sorted(box.texts.items())), frozenset(box.flags))
                others.setdefault(key, box)
        return [Box({a: i}) for a, intervals in single.items() for i in merged(intervals)] + list(others.values())

    def _cuts(self, attribute: str) -> list[float]:
        ends = {e for box in self.boxes if attribute in box.numbers for e in (box.numbers[attribute].low, box.numbers[attribute].high)}
        ends = sorted({e + 0.0 for e in ends if e is not None and math.isfinite(e)})
        step = max(1, math.ceil(len(ends) / MOST_CUTS))
        return ends[::step]

    def _bins(self, attribute: str, interval: Interval) -> tuple[list[int], list[int]]:
        """The coarse bins that lie within an interval's run of bins, and the other bins of the run."""
        cuts = self.cuts[attribute]
        first = 0 if interval.low is None else bisect_right(cuts, interval.low)
        # NaN has a bin of its own after the last.
        last = len(cuts) + 1 if interval.high is None else bisect_right(cuts, interval.high)
        coarse = list(range(-(-first // COARSE), (last + 1) // COARSE))
        inside = range(coarse[0] * COARSE, (coarse[-1] + 1) * COARSE) if coarse else range(0)
        return coarse, [b for b in range(first, last + 1) if b not in inside]

    def _filed(self, boxes: Sequence[Box]) -> dict[tuple[str, str], dict[int | str, list[tuple]]]:
        """The boxes under one part each: (kind of key, attribute) to key to boxes."""
        found: dict[tuple[str, str], dict[int | str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
        for box in boxes:
            row = (
                [(self.attributes.index(a), i.low, i.above, i.high, i.below) for a, i in box.numbers.items()],
                [(self.texts.index(a), t) for a, t in box.texts.items()],
                sorted(box.flags),
            )
            if box.texts:
                attribute = min(box.texts)
                found["text", attribute][box.texts[attribute]].append(row)
                continue
            runs = {a: self._bins(a, i) for a, i in box.numbers.items()}
            attribute = min(runs, key=lambda a: (COARSE * len(runs[a][0]) + len(runs[a][1]), a))
            for level, bins in zip(("coarse", "fine"), runs[attribute], strict=True):
                for number in bins:
                    found[level, attribute][number].append(row)
        return found

    def matched(self, transactions: DataFrame) -> tuple[DataFrame, Column]:
        """The transactions with further columns, none of them in more rows than before, and the condition that some rule holds, never NULL.

        An index table has one row a bin or text and at most ``INDEX_SIZE`` conjunctions, each in some 60 bins at most, and is broadcast.
        """
        spark, out, taken = transactions.sparkSession, transactions, {c.lower() for c in transactions.columns}

        def unused(name: str) -> str:
            while name.lower() in taken:
                name = "_" + name
            taken.add(name.lower())
            return name

        hits = [F.coalesce(condition, F.lit(False)) for condition in self.compiled]
        numbers = F.array(*[F.col(a).cast("double") for a in self.attributes]) if self.attributes else F.array().cast("array<double>")
        texts = F.array(*[F.col(a) for a in self.texts]) if self.texts else F.array().cast("array<string>")
        flags = F.array(*[F.coalesce(c, F.lit(False)) for c in self.flags.values()]) if self.flags else F.array().cast("array<boolean>")
        files = [self._filed(self.boxes[start : start + INDEX_SIZE]) for start in range(0, len(self.boxes), INDEX_SIZE)]
        if files:
            held = {name: unused(f"_{name}") for name in ("numbers", "texts", "flags")}
            out = out.withColumns({held["numbers"]: numbers, held["texts"]: texts, held["flags"]: flags})
            bins = {}
            for attribute in sorted({a for filed in files for level, a in filed if level != "text"}):
                bins[attribute] = unused("_bin")
                out = self._binned(out, attribute, bins[attribute], unused("_number"))
            for filed in files:
                for (level, attribute), rows in sorted(filed.items()):
                    key, boxes = unused("_key"), unused("_boxes")
                    kind = "string" if level == "text" else "int"
                    index = spark.createDataFrame(list(rows.items()), f"{key} {kind}, {boxes} array<{_BOX}>", verifySchema=False)
                    own = F.col(attribute) if level == "text" else F.col(bins[attribute])
                    own = F.floor(own / COARSE).cast("int") if level == "coarse" else own
                    out = out.join(F.broadcast(index), own == F.col(key), "left")
                    holds = F.exists(boxes, lambda box: _holds(box, *(F.col(held[n]) for n in ("numbers", "texts", "flags"))))
                    hits.append(F.coalesce(holds, F.lit(False)))
        condition = F.lit(False)
        for hit in hits:
            condition = condition | hit
        return out, condition

    def _binned(self, df: DataFrame, attribute: str, name: str, number: str) -> DataFrame:
        """``df`` with the number of the attribute's bin; NaN lies after the last, and so does NULL, which matches nothing there."""
        cuts = self.cuts[attribute]
        if not cuts:
            return df.withColumn(name, F.when(F.isnan(F.col(attribute).cast("double")), 1).otherwise(0))
        splits = [-math.inf, *cuts, math.inf]
        bucketizer = Bucketizer(splits=splits, inputCol=number, outputCol=name, handleInvalid="keep")
        x = F.col(attribute).cast("double")
        # Both zeros lie in one bin.
        binned = bucketizer.transform(df.withColumn(number, F.when(x == 0, 0.0).otherwise(x)))
        return binned.withColumn(name, F.col(name).cast("int"))


def _holds(box: Column, numbers: Column, texts: Column, flags: Column) -> Column:
    """Whether all parts of a conjunction hold."""

    def within(part: Column) -> Column:
        x = F.get(numbers, part["a"])
        low = part["low"].isNull() | (x > part["low"]) | (~part["above"] & (x == part["low"]))
        high = part["high"].isNull() | (x < part["high"]) | (~part["below"] & (x == part["high"]))
        return x.isNotNull() & low & high

    return (
        F.forall(box["numbers"], within)
        & F.forall(box["texts"], lambda part: F.coalesce(F.get(texts, part["a"]) == part["text"], F.lit(False)))
        & F.forall(box["flags"], lambda k: F.get(flags, k))
    )
