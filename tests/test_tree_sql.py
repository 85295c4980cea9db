"""Tree models compiled to SQL against the models themselves, in Spark and in another database."""

import duckdb
import pytest
from pyspark.sql import functions as F

from txsieve.operators import model, tree_sql
from txsieve.plans import tables

SF_DIR = "/root/testdata/sf0.01"
TREES = ("RANDOM_FOREST", "GBT")


@pytest.fixture(scope="module")
def history(spark):
    return tables.labelled_history(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def live(spark):
    return tables.enriched_live(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def fitted(history):
    return {name: model.train(history, name) for name in TREES}


@pytest.fixture(scope="module")
def compiled(spark, fitted):
    return {name: tree_sql.compiled(spark, one) for name, one in fitted.items()}


@pytest.mark.parametrize("name", TREES)
def test_verdicts_equal_the_model_row_by_row(fitted, compiled, live, name):
    """On the fraud label, which takes several features and deep trees."""
    found = dict(tree_sql.score(compiled[name], live).collect())
    assert found == dict(model.score(fitted[name], live).collect())
    assert 50 < sum(found.values()) < len(found) / 2
    clean = tree_sql.undetected_scored(compiled[name], live)
    assert clean.columns == live.columns
    assert clean.count() == sum(v == 0 for v in found.values())


@pytest.mark.parametrize("name", TREES)
def test_another_database_reads_the_same_text(compiled, live, name):
    columns = ["tid", "type", *model.NUMERIC_FEATURES]
    rows = live.select(*columns).toPandas()  # noqa: F841
    found = duckdb.sql(f"SELECT tid, CAST({compiled[name].fraud_sql()} AS INT) FROM rows").fetchall()
    assert dict(found) == dict(tree_sql.score(compiled[name], live).collect())


@pytest.mark.parametrize("name", TREES)
def test_kept_invalid_rows(spark, history, enriched, name):
    odd = enriched(
        {"tid": 1, "type": "ZZZ"}, {"tid": 2, "type": None}, {"tid": 3, "type": "VIEW", "amount": None}, {"tid": 4, "type": "ERROR", "amount": float("nan")},
        {"tid": 5, "type": "CLICK", "errorBalanceDest": None}, {"tid": 6, "type": "ERROR", "amount": 1e9, "errorBalanceDest": 500},
    )
    kept = model.train(history, name, handle_invalid="keep")
    assert sorted(tree_sql.score(tree_sql.compiled(spark, kept), odd).collect()) == sorted(model.score(kept, odd).collect())


@pytest.mark.parametrize("row", [{"type": "ZZZ"}, {"type": None}, {"type": "VIEW", "amount": None}])
def test_invalid_rows_fail_as_in_the_model(compiled, enriched, row):
    with pytest.raises(Exception, match="unseen in training or a missing number"):
        tree_sql.score(compiled["GBT"], enriched({"tid": 1, **row})).collect()


def test_a_fit_repeats_however_its_rows_came(spark, history, compiled):
    for shuffled in (history.repartition(7, F.rand(3)), history.coalesce(1).orderBy(F.desc("tid"))):
        assert tree_sql.compiled(spark, model.train(shuffled, "RANDOM_FOREST")) == compiled["RANDOM_FOREST"]


def test_other_models_have_no_trees(spark, history):
    with pytest.raises(ValueError, match="LogisticRegressionModel has no trees"):
        tree_sql.compiled(spark, model.train(history, "LOGISTIC_REGRESSION"))
