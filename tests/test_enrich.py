import pytest

from txsieve.operators import lookup as joins
from txsieve.operators.enrich import (
    PAIR,
    add_balance_errors,
    add_dest_blacklisted,
    add_recurrence,
    enrich,
    pair_counts,
)
from txsieve.schema import ENRICHED_SCHEMA, RAW_SCHEMA
from txsieve.sinks.tables import save_bucketed


def _by_tid(df, *columns):
    return {r["tid"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_recurrence(raw):
    history = raw(*[{"nameOrig": "C1", "nameDest": "M1"}] * 3, {"nameOrig": "C2"}, {"nameOrig": None})
    live = raw(
        {"tid": 1},
        {"tid": 2, "nameOrig": "C2"},
        {"tid": 3, "nameOrig": "C9"},
        {"tid": 4, "nameOrig": None},
        {"tid": 5, "nameOrig": "c1"},
    )
    expected = {1: (3,), 2: (1,), 3: (0,), 4: (0,), 5: (0,)}
    assert _by_tid(add_recurrence(live, history), "recurrence") == expected
    assert _by_tid(add_recurrence(live, pair_counts(history)), "recurrence") == expected
    appended = pair_counts(history.limit(2)).union(pair_counts(history.offset(2)))
    assert _by_tid(add_recurrence(live, appended), "recurrence") == expected


def test_blacklist_entries_listed_twice_count_once(spark, raw):
    blacklist = spark.createDataFrame([("M2",), ("M2",), (None,)], "accountNumber string")
    live = raw({"tid": 1}, {"tid": 2, "nameDest": "M2"}, {"tid": 3, "nameDest": None})
    out = add_dest_blacklisted(live, blacklist)
    assert out.count() == 3
    assert _by_tid(out, "destBlacklisted") == {1: (0,), 2: (1,), 3: (0,)}


def test_balance_errors_are_cut_toward_zero(raw):
    live = raw(
        {"tid": 1, "oldBalanceOrig": 100.0, "newBalanceOrig": 91.7, "oldBalanceDest": 0.0, "newBalanceDest": 11.7},
        {"tid": 2, "amount": 3e10, "oldBalanceDest": 0.0, "newBalanceDest": 6e10},
        {"tid": 3, "amount": float("nan")},
        {"tid": 4, "amount": None},
    )
    assert _by_tid(add_balance_errors(live), "errorBalanceOrig", "errorBalanceDest") == {
        1: (1, -1),
        2: (2147483647, -2147483648),
        3: (0, 0),
        4: (None, None),
    }


def test_enrich_keeps_all_rows_and_further_columns(spark, raw):
    blacklist = spark.createDataFrame([("M1",)], "accountNumber string")
    live = raw({"tid": 1}, {"tid": 1}, {"tid": 2, "nameDest": "M7"})
    out = enrich(live, live, blacklist)
    assert out.columns == ENRICHED_SCHEMA.fieldNames()
    assert [f.dataType for f in out.schema] == [f.dataType for f in ENRICHED_SCHEMA]
    assert sorted((r["tid"], r["recurrence"], r["destBlacklisted"]) for r in out.collect()) == [
        (1, 2, 1),
        (1, 2, 1),
        (2, 1, 0),
    ]
    more = enrich(live.selectExpr("*", "1 AS isFraud"), live, blacklist)
    assert more.columns == [*ENRICHED_SCHEMA.fieldNames(), "isFraud"]


@pytest.mark.parametrize("hot_rows", [1, 2, 10**6])
def test_history_enriched_by_itself(spark, raw, monkeypatch, hot_rows):
    """The same frame on both sides, whatever counts as a hot key."""
    monkeypatch.setattr(joins, "ROWS_PER_TASK", hot_rows)
    blacklist = spark.createDataFrame([("M1",), ("M8",)], "accountNumber string")
    past = raw(
        *[{"tid": i} for i in range(5)],
        {"tid": 5, "nameDest": "M7"},
        {"tid": 6, "nameOrig": None},
        *[{"tid": 7 + i, "nameOrig": None, "nameDest": None} for i in range(4)],
    )
    expected = {i: (5, 1) for i in range(5)} | {5: (1, 0), 6: (0, 1)} | {7 + i: (0, 0) for i in range(4)}
    out = enrich(past, past, blacklist)
    assert out.count() == 11
    assert _by_tid(out, "recurrence", "destBlacklisted") == expected


def test_bucketed_counts_are_not_shuffled(spark, raw, folder, capsys):
    history = raw(*[{"nameDest": f"M{i % 7}"} for i in range(20)])
    save_bucketed(pair_counts(history), "pair_counts_of_a_test", PAIR, 4)
    path = folder()
    raw(*[{"tid": i, "nameDest": f"M{i}"} for i in range(9)]).write.parquet(path)
    live = spark.read.schema(RAW_SCHEMA).parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = add_recurrence(live, spark.table("pair_counts_of_a_test"), few=True)
        out.explain()
        # The batch's distinct keys, and the batch.
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
        assert _by_tid(out, "recurrence") == {i: (3 if i < 6 else 2 if i < 7 else 0,) for i in range(9)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE pair_counts_of_a_test")
