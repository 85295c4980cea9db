import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txsieve.operators import model
from txsieve.plans import tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    return tables.labelled_history(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def live(spark):
    return tables.enriched_live(spark, SF_DIR).persist()


def test_features_by_hand(enriched):
    rows = [{"tid": i, "type": t} for i, t in enumerate(["B", "B", "B", "A", "C", "A", "D"])]
    df = enriched(*rows)
    out = model.fit_features(df).transform(df)
    got = {
        r["type"]: (r["typeIndex"], list(r["v"]), list(r["f"]))
        for r in out.select(
            "type", "typeIndex", vector_to_array("typeVec").alias("v"), vector_to_array("features").alias("f")
        ).collect()
    }
    numbers = [10.0, 5000.0, 4990.0, 100.0, 110.0, 1.0, 0.0, 0.0]
    # Most frequent first, equal counts in alphabetical order, no slot for the last.
    assert got["B"] == (0.0, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0] + numbers)
    assert got["A"] == (1.0, [0.0, 1.0, 0.0], [0.0, 1.0, 0.0] + numbers)
    assert got["C"] == (2.0, [0.0, 0.0, 1.0], [0.0, 0.0, 1.0] + numbers)
    assert got["D"] == (3.0, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0] + numbers)


@pytest.mark.parametrize("name", model.MODELS)
def test_scores(history, live, name):
    fitted = model.train(history, name)
    first = sorted(model.score(fitted, live).collect())
    assert [r["tid"] for r in first] == sorted(r["tid"] for r in live.select("tid").collect())
    assert {r["isFraud"] for r in first} <= {0, 1}
    assert sorted(model.score(model.train(history, name), live).collect()) == first
    clean = model.undetected_scored(fitted, live)
    assert clean.columns == live.columns
    assert clean.count() == sum(r["isFraud"] == 0 for r in first)


def test_trees_find_frauds(history, live):
    expected = live.select(
        "tid", ((F.col("errorBalanceDest") != 0) & ((F.col("destBlacklisted") == 1) | (F.col("amount") > 100)))
        .cast("int").alias("label")
    )
    for name in ("RANDOM_FOREST", "GBT"):
        scored = model.score(model.train(history, name), live)
        assert scored.join(expected, "tid").filter("isFraud = 1 AND label = 1").count() >= 4


def test_logistic_regression_keeps_no_feature_here(history):
    fitted = model.train(history, "LOGISTIC_REGRESSION").stages[-1]
    assert fitted.coefficients.numNonzeros() == 0
    assert (fitted.getRegParam(), fitted.getElasticNetParam(), fitted.getMaxIter()) == (0.3, 0.8, 5)


def test_parameters():
    forest, boosted = model.classifier("RANDOM_FOREST"), model.classifier("GBT")
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (20, 5, model.SEED)
    assert (boosted.getMaxIter(), boosted.getSeed()) == (5, model.SEED)
    with pytest.raises(ValueError):
        model.classifier("random_forest")


def test_unseen_type(history, enriched):
    odd = enriched({"tid": 1, "type": "ZZZ"}, {"tid": 2, "type": "VIEW", "amount": None})
    with pytest.raises(Exception, match="ZZZ|[Nn]ull"):
        model.score(model.train(history), odd).collect()
    kept = model.score(model.train(history, handle_invalid="keep"), odd)
    assert sorted(r["tid"] for r in kept.collect()) == [1, 2]


def test_save_and_load(history, live, folder):
    fitted, path = model.train(history), folder("model")
    model.save(fitted, path)
    assert sorted(model.score(model.load(path), live).collect()) == sorted(model.score(fitted, live).collect())


def _leaf(nodes, values):
    """The leaf of one saved tree that a feature vector falls into."""
    node = nodes[0]
    while node["leftChild"] >= 0:
        split = node["split"]
        value, bound = values[split["featureIndex"]], split["leftCategoriesOrThreshold"]
        goes_left = value <= bound[0] if split["numCategories"] < 0 else value in bound
        node = nodes[node["leftChild"] if goes_left else node["rightChild"]]
    return node


def _forest_verdict(trees, weights, values):
    frauds = 0.0
    for number, nodes in trees.items():
        clean, fraud = _leaf(nodes, values)["impurityStats"]
        frauds += weights[number] * (fraud / (clean + fraud))
    return int(frauds > sum(weights) / 2)


def _boosted_verdict(trees, weights, values):
    return int(sum(weights[n] * _leaf(nodes, values)["prediction"] for n, nodes in trees.items()) > 0)


@pytest.mark.parametrize("name, verdict", [("RANDOM_FOREST", _forest_verdict), ("GBT", _boosted_verdict)])
def test_scores_equal_walking_the_trees(spark, history, live, folder, name, verdict):
    """Each transaction is dropped through the saved trees by hand."""
    fitted, path = model.train(history, name), folder("model")
    model.save(fitted, path)
    trees = {}
    for row in spark.read.parquet(f"{path}/stages/3_{fitted.stages[-1].uid}/data").collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    weights = fitted.stages[-1].treeWeights
    assert len(trees) == len(weights) == {"RANDOM_FOREST": 20, "GBT": 5}[name]

    types = {label: i for i, label in enumerate(fitted.stages[0].labels)}
    expected = {}
    for row in live.collect():
        onehot = [float(types[row["type"]] == i) for i in range(len(types) - 1)]
        values = onehot + [float(row[c]) for c in model.NUMERIC_FEATURES]
        expected[row["tid"]] = verdict(trees, weights, values)
    assert {r["tid"]: r["isFraud"] for r in model.score(fitted, live).collect()} == expected
    assert 0 < sum(expected.values()) < len(expected)
