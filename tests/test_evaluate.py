import itertools
from collections import Counter

import pytest

from txsieve.operators.evaluate import complete, confusion, eval_pairs, metrics, report_lines
from txsieve.schema import DETECTION_SCHEMA


@pytest.fixture
def verdict_frame(spark):
    return lambda rows: spark.createDataFrame(rows, DETECTION_SCHEMA)


# Duplicates on both sides, a tid on one side only, values beyond 0 and 1, NULLs.
DETECTED = [(1, 1), (2, 0), (3, 1), (3, 1), (3, 0), (4, 0), (5, 2), (6, None), (7, 1), (None, 1)]
EXPECTED = [(1, 1), (2, 0), (3, 1), (3, 0), (4, 1), (4, 1), (5, 1), (6, 1), (8, 1), (None, 1)]


def _pairs():
    return [(t, e, a) for (t, a), (u, e) in itertools.product(DETECTED, EXPECTED) if t is not None and t == u]


def test_pairs(verdict_frame):
    out = eval_pairs(verdict_frame(DETECTED), verdict_frame(EXPECTED))
    assert out.columns == ["tid", "expected", "actual"]
    assert Counter(tuple(r) for r in out.collect()) == Counter(_pairs())


def test_confusion_equals_counting_the_pairs(verdict_frame):
    cells = Counter((e, a) for _, e, a in _pairs())
    row = confusion(verdict_frame(DETECTED), verdict_frame(EXPECTED)).first()
    assert row.asDict() == {
        "processed": len(_pairs()),
        "tp": cells[1, 1],
        "tn": cells[0, 0],
        "fp": cells[0, 1],
        "fn": cells[1, 0],
    }


def test_metrics(verdict_frame):
    detected = verdict_frame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)])
    expected = verdict_frame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 1)])
    row = metrics(detected, expected).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.4, 0.5, pytest.approx(1 / 3))
    assert report_lines(metrics(detected, expected))[:6] == [
        "Processed 5 records.",
        "TP: 1",
        "TN: 1",
        "FP: 1",
        "FN: 2",
        "Accuracy: 0.4",
    ]


def test_metrics_without_positives_or_rows(verdict_frame):
    clean = verdict_frame([(1, 0), (2, 0)])
    row = metrics(clean, clean).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (1.0, None, None)
    row = metrics(verdict_frame([]), clean).first()
    assert (row["processed"], row["tp"], row["accuracy"]) == (0, 0, None)


def test_complete(verdict_frame):
    out = complete(verdict_frame([(1, 1), (1, 1), (9, 1)]), verdict_frame([(1, 1), (2, 0), (2, 0)]))
    assert sorted(out.collect()) == [(1, 1), (2, 0)]


def test_confusion_moves_each_side_once(verdict_frame, spark, folder, capsys):
    """The counts per tid are joined as they lie, without a further shuffle."""
    frames = []
    for rows in (DETECTED, EXPECTED):
        path = folder()
        verdict_frame(rows).write.parquet(path)
        frames.append(spark.read.schema(DETECTION_SCHEMA).parquet(path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        confusion(*frames).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert capsys.readouterr().out.count("Exchange hashpartitioning(tid") == 2
