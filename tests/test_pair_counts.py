"""Pair counts in parts: a batch reads its own, layers are added and merged, results equal the full join."""

import re

import pytest
from pyspark.sql import functions as F

from txsieve.operators.enrich import add_recurrence
from txsieve.plans import tables
from txsieve.sinks import commits, pair_counts
from txsieve.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def past(spark):
    return tables.raw_history(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def live(spark):
    return tables.raw_live(spark, SF_DIR).persist()


def _recurrence(df):
    return sorted(df.select("tid", "recurrence").collect())


def _parts_read(df):
    return {int(n) for n in re.findall(r"/part=(\d+)/", " ".join(r[0] for r in df.select(F.input_file_name()).distinct().collect()))}


def test_results_equal_the_full_join(spark, past, live, folder):
    path = folder()
    pair_counts.start_pair_counts(past, path, parts=16)
    expected = _recurrence(add_recurrence(live, past))
    assert _recurrence(add_recurrence(live, pair_counts.read_pair_counts(spark, path))) == expected
    assert _recurrence(add_recurrence(live, pair_counts.read_pair_counts(spark, path, live), few=True)) == expected
    assert any(n for _, n in expected)


def test_a_batch_reads_its_parts_alone(spark, past, live, folder, capsys):
    path = folder()
    pair_counts.start_pair_counts(past, path, parts=64)
    batch = live.limit(5)
    wanted = {r["p"] for r in batch.select(pair_counts.part_of(64).alias("p")).collect()}
    counts = pair_counts.read_pair_counts(spark, path, batch)
    counts.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    read = _parts_read(counts)
    assert read and read <= wanted and len(wanted) <= 5
    assert len(_parts_read(pair_counts.read_pair_counts(spark, path))) > 30
    assert _recurrence(add_recurrence(batch, counts, few=True)) == _recurrence(add_recurrence(batch, past))


def test_layers_add_up_and_merge(spark, past, live, folder):
    path = folder()
    third = F.pmod("tid", F.lit(3))
    pair_counts.start_pair_counts(past.filter(third == 0), path, parts=8)
    assert pair_counts.add_pair_counts(past.filter(third == 1), path) == 1
    expected = _recurrence(add_recurrence(live, past.filter(third != 2)))
    assert _recurrence(add_recurrence(live, pair_counts.read_pair_counts(spark, path))) == expected
    assert pair_counts.merge_pair_counts(spark, path) == 1
    assert pair_counts.merge_pair_counts(spark, path) == 1
    assert _recurrence(add_recurrence(live, pair_counts.read_pair_counts(spark, path, live))) == expected
    assert pair_counts.add_pair_counts(past.filter(third == 2), path) == 2
    whole = _recurrence(add_recurrence(live, past))
    assert _recurrence(add_recurrence(live, pair_counts.read_pair_counts(spark, path, live))) == whole
    assert pair_counts.merge_pair_counts(spark, path) == 2
    assert _recurrence(add_recurrence(live, pair_counts.read_pair_counts(spark, path))) == whole


def test_a_layer_counts_once_its_row_is_written(spark, raw, folder, monkeypatch):
    path = folder()
    pair_counts.start_pair_counts(raw({"tid": 1}, {"tid": 2}), path, parts=4)
    monkeypatch.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        pair_counts.add_pair_counts(raw({"tid": 3}), path)
    monkeypatch.undo()
    assert _recurrence(add_recurrence(raw({"tid": 9}), pair_counts.read_pair_counts(spark, path))) == [(9, 2)]
    assert pair_counts.add_pair_counts(raw({"tid": 3}), path) == 1
    assert _recurrence(add_recurrence(raw({"tid": 9}), pair_counts.read_pair_counts(spark, path))) == [(9, 3)]


def test_missing_accounts_and_empty_history(spark, raw, folder):
    path = folder()
    pair_counts.start_pair_counts(raw({"nameOrig": None}, {"nameDest": None}).limit(0), path, parts=4)
    batch = raw({"tid": 1}, {"tid": 2, "nameOrig": None})
    assert _recurrence(add_recurrence(batch, pair_counts.read_pair_counts(spark, path, batch))) == [(1, 0), (2, 0)]
    pair_counts.add_pair_counts(raw({"nameOrig": None}, {"nameDest": None}, {}), path)
    assert _recurrence(add_recurrence(batch, pair_counts.read_pair_counts(spark, path, batch))) == [(1, 1), (2, 0)]
