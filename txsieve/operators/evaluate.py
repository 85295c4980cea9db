"""Detections against expected labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eval_pairs(detections: DataFrame, expected: DataFrame) -> DataFrame:
    """``(tid, expected, actual)`` for each pair of rows with equal ``tid``; duplicates multiply."""
    actual = detections.select("tid", F.col("isFraud").alias("actual"))
    right = expected.select("tid", F.col("isFraud").alias("expected"))
    return actual.join(right, "tid").select("tid", "expected", "actual")


def complete(detections: DataFrame, expected: DataFrame) -> DataFrame:
    """A verdict for each expected ``tid``: what was detected, 0 where nothing was.

    For detectors that report frauds only.
    """
    found = detections.groupBy("tid").agg(F.max("isFraud").alias("isFraud"))
    tids = expected.select("tid").distinct()
    return tids.join(found, "tid", "left").select(
        "tid", F.coalesce(F.col("isFraud"), F.lit(0)).alias("isFraud")
    )


def _per_tid(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.groupBy("tid").agg(
        F.count("*").alias(f"{prefix}_all"),
        F.count_if(F.col("isFraud") == 1).alias(f"{prefix}_fraud"),
        F.count_if(F.col("isFraud") == 0).alias(f"{prefix}_clean"),
    )


def confusion(detections: DataFrame, expected: DataFrame) -> DataFrame:
    """One row ``processed, tp, tn, fp, fn``, the counts over :func:`eval_pairs`.

    Each side is first counted per ``tid``, so that a ``tid`` with many copies on both sides is one
    multiplication, not a product of rows.
    """
    both = _per_tid(detections, "a").join(_per_tid(expected, "e"), "tid")

    def total(left: str, right: str) -> Column:
        return F.coalesce(F.sum(F.col(left) * F.col(right)), F.lit(0))

    return both.agg(
        total("e_all", "a_all").alias("processed"),
        total("e_fraud", "a_fraud").alias("tp"),
        total("e_clean", "a_clean").alias("tn"),
        total("e_clean", "a_fraud").alias("fp"),
        total("e_fraud", "a_clean").alias("fn"),
    )


def metrics(detections: DataFrame, expected: DataFrame) -> DataFrame:
    """:func:`confusion` with ``accuracy, precision, recall``, each NULL where nothing was counted."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    return confusion(detections, expected).select(
        "*",
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
    )


def report_lines(measured: DataFrame) -> list[str]:
    """The eight lines of the evaluation report, from a frame made by :func:`metrics`."""
    row = measured.first()
    # The wording and order of the lines.
    return [
        f"Processed {row['processed']} records.",
        *(f"{name.upper()}: {row[name]}" for name in ("tp", "tn", "fp", "fn")),
        *(f"{name.capitalize()}: {row[name]}" for name in ("accuracy", "precision", "recall")),
    ]
