"""Detection by a classifier trained on labelled history."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.sinks import commits

# The inputs of the model after the encoded type, and the classifiers' parameters.
NUMERIC_FEATURES = [
    "amount",
    "oldBalanceOrig",
    "newBalanceOrig",
    "oldBalanceDest",
    "newBalanceDest",
    "recurrence",
    "errorBalanceOrig",
    "errorBalanceDest",
]
MODELS = ("RANDOM_FOREST", "GBT", "LOGISTIC_REGRESSION")

LABEL = "isFraud"
SEED = 42
#: Training rows in one partition, about.
ROWS_PER_PART = 250_000


def feature_stages(handle_invalid: str = "error") -> list:
    """Index and one-hot encode ``type``, then put all inputs into one vector ``features``.

    ``handle_invalid="keep"`` lets unseen types and missing numbers through instead of failing.
    """
    return [
        StringIndexer(
            inputCol="type",
            outputCol="typeIndex",
            stringOrderType="frequencyDesc",
            handleInvalid=handle_invalid,
        ),
        OneHotEncoder(inputCols=["typeIndex"], outputCols=["typeVec"]),
        VectorAssembler(
            inputCols=["typeVec", *NUMERIC_FEATURES], outputCol="features", handleInvalid=handle_invalid
        ),
    ]


def classifier(model: str, seed: int = SEED):
    """The classifier of one of the names in ``MODELS``."""
    columns = {"labelCol": LABEL, "featuresCol": "features"}
    if model == "RANDOM_FOREST":
        return RandomForestClassifier(seed=seed, **columns)
    if model == "GBT":
        return GBTClassifier(maxIter=5, seed=seed, **columns)
    if model == "LOGISTIC_REGRESSION":
        return LogisticRegression(elasticNetParam=0.8, regParam=0.3, maxIter=5, **columns)
    raise ValueError(f"unknown model {model!r}, choose one of {', '.join(MODELS)}")


def _fit(stages: list, history: DataFrame, columns: list[str]) -> PipelineModel:
    # Fitting passes over the rows many times: keep just the needed columns, on disk where memory ends. Samples are drawn by a
    # row's place, so the rows are put where their values and number alone say: a fit repeats however its rows came.
    needed = history.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    training = None
    try:
        parts = max(1, math.ceil(needed.count() / ROWS_PER_PART))
        placed = needed.repartition(parts, *columns).sortWithinPartitions(*columns)
        training = placed.persist(StorageLevel.MEMORY_AND_DISK)
        return Pipeline(stages=stages).fit(training)
    finally:
        needed.unpersist()
        if training is not None:
            training.unpersist()


def fit_features(history: DataFrame, handle_invalid: str = "error") -> PipelineModel:
    """The feature stages alone, fitted on the history."""
    return _fit(feature_stages(handle_invalid), history, ["type", *NUMERIC_FEATURES])


def train(
    history: DataFrame, model: str = "RANDOM_FOREST", seed: int = SEED, handle_invalid: str = "error"
) -> PipelineModel:
    """Feature stages and classifier, fitted on labelled history."""
    stages = [*feature_stages(handle_invalid), classifier(model, seed)]
    return _fit(stages, history, ["type", *NUMERIC_FEATURES, LABEL])


def score(model: PipelineModel, transactions: DataFrame) -> DataFrame:
    """``(tid, isFraud)`` for every transaction, of a table or a stream."""
    return model.transform(transactions).select("tid", F.col("prediction").cast("int").alias("isFraud"))


def undetected_scored(model: PipelineModel, transactions: DataFrame) -> DataFrame:
    """The transactions the model finds clean, all their columns."""
    scored = model.transform(transactions).filter(F.col("prediction") == 0.0)
    return scored.select(*transactions.columns)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def version_path(folder: str, version: int) -> str:
    return f"{folder.rstrip('/')}/version={version}"


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The number of the latest complete model of a folder, None without one."""
    return commits.latest(spark, folder, "model")


def publish(model: PipelineModel, spark: SparkSession, folder: str) -> int:
    """Save a model as the next version of a folder and give its number. Jobs take it once it is complete; older versions stay."""
    version = (latest_version(spark, folder) or 0) + 1
    save(model, version_path(folder, version))
    commits.commit(spark, folder, "model", version)
    return version
