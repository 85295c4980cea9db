"""Features a transaction gets before detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.functions.numeric import count_to_int, trunc_int
from txsieve.operators.lookup import left_lookup
from txsieve.schema import ENRICHED_SCHEMA

PAIR = ["nameOrig", "nameDest"]


def pair_counts(history: DataFrame) -> DataFrame:
    """How many past transactions each pair of accounts has; ``pairCount`` is the count."""
    return history.groupBy(*PAIR).agg(F.count("*").alias("pairCount"))


def _as_pair_counts(history: DataFrame) -> DataFrame:
    if "pairCount" not in history.columns:
        return pair_counts(history)
    # Adding up lets new counts be appended to such a table.
    return history.groupBy(*PAIR).agg(F.sum("pairCount").alias("pairCount"))


def add_recurrence(
    transactions: DataFrame, history: DataFrame, keys_from: DataFrame | None = None, **dealing
) -> DataFrame:
    """Add ``recurrence``: past transactions between the same two accounts, 0 if none.

    ``history`` is either past transactions or a table :func:`pair_counts` made of them, to which counts
    of later transactions may have been appended. ``dealing`` goes to :func:`left_lookup`.
    """
    joined = left_lookup(transactions, _as_pair_counts(history), PAIR, keys_from, **dealing)
    return joined.select(*transactions.columns, count_to_int(F.col("pairCount")).alias("recurrence"))


def add_dest_blacklisted(
    transactions: DataFrame, blacklist: DataFrame, keys_from: DataFrame | None = None, **dealing
) -> DataFrame:
    """Add ``destBlacklisted``: 1 if ``nameDest`` is an account in ``blacklist``, else 0. ``dealing`` goes to :func:`left_lookup`."""
    listed = (
        blacklist.select(F.col("accountNumber").alias("nameDest"))
        .distinct()
        .withColumn("_listed", F.lit(1))
    )
    joined = left_lookup(transactions, listed, ["nameDest"], keys_from, **dealing)
    return joined.select(
        *transactions.columns, F.coalesce(F.col("_listed"), F.lit(0)).alias("destBlacklisted")
    )


def error_balance_orig() -> Column:
    """By how much the origin's balances disagree with the amount, in whole units."""
    return trunc_int(F.col("newBalanceOrig") + F.col("amount") - F.col("oldBalanceOrig"))


def error_balance_dest() -> Column:
    """By how much the destination's balances disagree with the amount, in whole units."""
    return trunc_int(F.col("oldBalanceDest") + F.col("amount") - F.col("newBalanceDest"))


def add_balance_errors(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        "*",
        error_balance_orig().alias("errorBalanceOrig"),
        error_balance_dest().alias("errorBalanceDest"),
    )


def enrich(
    transactions: DataFrame, history: DataFrame, blacklist: DataFrame, keys_from: DataFrame | None = None, **dealing
) -> DataFrame:
    """All four features, in the order of ``ENRICHED_SCHEMA``, with any further columns after them.

    ``keys_from`` may name a frame that gives the account columns of the same transactions more cheaply. ``dealing`` goes to
    :func:`left_lookup`, such as ``few=True`` for a micro-batch.
    """
    keys_from = transactions if keys_from is None else keys_from
    counted = add_recurrence(transactions, history, keys_from, **dealing)
    flagged = add_dest_blacklisted(counted, blacklist, keys_from, **dealing)
    out = add_balance_errors(flagged)
    names = ENRICHED_SCHEMA.fieldNames()
    return out.select(*names, *[c for c in transactions.columns if c not in names])
