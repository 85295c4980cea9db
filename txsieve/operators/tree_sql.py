"""Fitted tree models as one SQL expression over a transaction's own columns: no vectors, no model object where it is used."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.operators.model import NUMERIC_FEATURES, load, save
from txsieve.session import new_run_folder


@dataclass(frozen=True)
class Leaf:
    prediction: float
    #: How many clean and fraudulent training rows fell into it.
    counts: tuple[float, ...]


@dataclass(frozen=True)
class Split:
    feature: int
    #: A number goes left up to this bound; a one-hot slot goes left by these values.
    bound: float | None
    values: tuple[float, ...]
    left: Split | Leaf
    right: Split | Leaf


@dataclass(frozen=True)
class TreeModel:
    """A forest or boosted trees with the types its first features stand for, most frequent first."""

    boosted: bool
    trees: tuple[Split | Leaf, ...]
    weights: tuple[float, ...]
    types: tuple[str, ...]
    keep_invalid: bool

    def slots(self) -> int:
        """One-hot features: the last type has none, unless unseen types take that place."""
        return len(self.types) - (0 if self.keep_invalid else 1)

    def fraud_sql(self) -> str:
        """Whether a transaction is a fraud, as SQL that Spark and other databases read alike.

        A forest weighs the shares of clean and fraudulent rows in its trees' leaves, boosted trees add up their leaves' values. Unseen types
        have no slot and missing numbers are above every bound, as ``handle_invalid="keep"`` has it.
        """
        if self.boosted:
            terms = [f"{_number(w)} * {self._tree(t, lambda leaf: leaf.prediction)}" for w, t in zip(self.weights, self.trees, strict=True)]
            return f"({_sum(terms)}) > {_number(0.0)}"
        clean, fraud = (
            _sum([self._tree(tree, lambda leaf, side=side: leaf.counts[side] / (sum(leaf.counts) or 1.0)) for tree in self.trees]) for side in (0, 1)
        )
        return f"({fraud}) > ({clean})"

    def _tree(self, node: Split | Leaf, value) -> str:
        if isinstance(node, Leaf):
            return _number(value(node))
        return f"(CASE WHEN {self._goes_left(node)} THEN {self._tree(node.left, value)} ELSE {self._tree(node.right, value)} END)"

    def _goes_left(self, node: Split) -> str:
        if node.feature >= self.slots():
            return f"CAST({NUMERIC_FEATURES[node.feature - self.slots()]} AS DOUBLE) <= {_number(node.bound)}"
        name = "'" + self.types[node.feature].replace("'", "''") + "'"
        held = {0.0: node.values and 0.0 in node.values, 1.0: node.values and 1.0 in node.values}
        if node.bound is not None:
            held = {x: x <= node.bound for x in held}
        if held[0.0] == held[1.0]:
            return "1 = 1" if held[0.0] else "1 = 0"
        return f"coalesce(type = {name}, 1 = 0)" if held[1.0] else f"NOT coalesce(type = {name}, 1 = 0)"

    def to_column(self) -> Column:
        """``isFraud``, 1 or 0. Like the model itself it fails on unseen types and missing numbers, unless the model keeps these."""
        verdict = F.expr(self.fraud_sql()).cast("int")
        if self.keep_invalid:
            return verdict
        usable = F.coalesce(F.col("type").isin(list(self.types)), F.lit(False))
        for name in NUMERIC_FEATURES:
            usable = usable & F.col(name).isNotNull()
        return F.when(usable, verdict).otherwise(F.raise_error(F.lit("a type unseen in training or a missing number")).cast("int"))


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _sum(terms: Sequence[str]) -> str:
    return " + ".join([_number(0.0), *terms])


def saved_trees(spark: SparkSession, path: str) -> TreeModel:
    """The trees of a saved model, a forest or boosted trees. A model's nodes are few and fit the driver, like the model itself."""
    fitted = load(path)
    classifier = fitted.stages[-1]
    if not isinstance(classifier, (RandomForestClassificationModel, GBTClassificationModel)):
        raise ValueError(f"{type(classifier).__name__} has no trees")
    nodes: dict[int, dict[int, dict]] = {}
    for row in spark.read.parquet(f"{path}/stages/{len(fitted.stages) - 1}_{classifier.uid}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"].asDict(recursive=True)

    def build(tree: dict[int, dict], number: int) -> Split | Leaf:
        node = tree[number]
        if node["leftChild"] < 0:
            return Leaf(node["prediction"], tuple(node["impurityStats"]))
        split = node["split"]
        bounds, number_of_values = split["leftCategoriesOrThreshold"], split["numCategories"]
        return Split(
            split["featureIndex"],
            bounds[0] if number_of_values < 0 else None,
            tuple(bounds) if number_of_values >= 0 else (),
            build(tree, node["leftChild"]),
            build(tree, node["rightChild"]),
        )

    indexer = fitted.stages[0]
    return TreeModel(
        isinstance(classifier, GBTClassificationModel),
        tuple(build(nodes[k], 0) for k in sorted(nodes)),
        tuple(classifier.treeWeights),
        tuple(indexer.labels),
        indexer.getHandleInvalid() == "keep",
    )


def compiled(spark: SparkSession, model: PipelineModel) -> TreeModel:
    """The trees of a fitted model, by way of a saved copy."""
    path = new_run_folder(spark, "model")
    save(model, path)
    return saved_trees(spark, path)


def score(trees: TreeModel, transactions: DataFrame) -> DataFrame:
    """``(tid, isFraud)`` for every transaction, of a table or a stream."""
    return transactions.select("tid", trees.to_column().alias("isFraud"))


def undetected_scored(trees: TreeModel, transactions: DataFrame) -> DataFrame:
    """The transactions the model finds clean, all their columns."""
    return transactions.filter(trees.to_column() == 0)
