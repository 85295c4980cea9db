"""The transaction tables, derived from the test tables ``events``, ``customer`` and ``supplier``.

Events of the first 15 days are the history, later ones the live transactions. The user is the origin
account; the destination account is the supplier that the user's number and the one in ``props`` lead to, so every
supplier can be one. The balances come from the customer and the supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.operators.enrich import enrich
from txsieve.operators.rules import Compound, Rule, RuleSet
from txsieve.sources.messages import FILES_PER_TRIGGER

_SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_acctbal double",
    "supplier": "s_suppkey long, s_acctbal double",
}
_START = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
_LIVE_FROM = "TIMESTAMP_NTZ '2024-01-16 00:00:00'"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter(f"ts < {_LIVE_FROM}")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter(f"ts >= {_LIVE_FROM}")


def _orig() -> Column:
    return F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig")


def _dest() -> Column:
    return F.concat(F.lit("M"), F.col("merchant").cast("string")).alias("nameDest")


def _with_merchant(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's supplier: a number below their count, which is one row."""
    counted = read(spark, sf_dir, "supplier").agg(F.count("*").alias("merchants")).withColumn("every", F.lit(1))
    k = F.get_json_object("props", "$.k").cast("int")
    joined = events.withColumn("every", F.lit(1)).join(F.broadcast(counted), "every")
    return joined.withColumn("merchant", F.pmod(F.col("user_id") + k, F.col("merchants")).cast("long"))


def _accounts(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts of each event alone, without the joins to their balances."""
    return _with_merchant(events, spark, sf_dir).select(_orig(), _dest())


def _transactions(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("origBalance"),
    )
    merchants = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("merchant"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("destBalance")
    )
    since = F.col("ts") - F.expr(_START)
    joined = _with_merchant(events, spark, sf_dir).join(accounts, "user_id").join(merchants, "merchant")
    return joined.select(
        F.col("event_id").alias("tid"),
        (F.extract(F.lit("DAYS"), since) * 24 + F.extract(F.lit("HOURS"), since)).cast("int").alias("step"),
        F.upper("event_type").alias("type"),
        F.col("value").cast("float").alias("amount"),
        _orig(),
        F.col("origBalance").cast("float").alias("oldBalanceOrig"),
        F.greatest(F.col("origBalance") - F.col("value"), F.lit(0.0)).cast("float").alias("newBalanceOrig"),
        _dest(),
        F.col("destBalance").cast("float").alias("oldBalanceDest"),
        F.when(F.col("event_type") == "error", F.col("destBalance"))
        .otherwise(F.col("destBalance") + F.col("value"))
        .cast("float")
        .alias("newBalanceDest"),
    )


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past transactions without features or labels."""
    return _transactions(_past(spark, sf_dir), spark, sf_dir)


def raw_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions to screen."""
    return _transactions(_live(spark, sf_dir), spark, sf_dir)


def live_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts of the transactions to screen."""
    return _accounts(_live(spark, sf_dir), spark, sf_dir)


def raw_live_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions to screen, as a stream of the events file."""
    events = (
        spark.readStream.schema(_SCHEMAS["events"])
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", FILES_PER_TRIGGER)
        .parquet(sf_dir)
        .filter(f"ts >= {_LIVE_FROM}")
    )
    return _transactions(events, spark, sf_dir)


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The destinations with over 1.35 times as many past errors as the average of those with any."""
    failed = _past(spark, sf_dir).filter(F.col("event_type") == "error")
    errors = _accounts(failed, spark, sf_dir).groupBy(F.col("nameDest").alias("accountNumber")).agg(F.count("*").alias("n"))
    average = errors.agg(F.sum("n").alias("errors"), F.count("*").alias("accounts")).withColumn("every", F.lit(1))
    joined = errors.withColumn("every", F.lit(1)).join(F.broadcast(average), "every")
    return joined.filter(F.col("n") * 20 * F.col("accounts") > F.col("errors") * 27).select("accountNumber")


def enriched_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, past = raw_live(spark, sf_dir), raw_history(spark, sf_dir)
    return enrich(live, past, blacklist(spark, sf_dir), live_accounts(spark, sf_dir))


def _label() -> Column:
    return F.when(
        (F.col("errorBalanceDest") != 0) & ((F.col("destBlacklisted") == 1) | (F.col("amount") > 100)), 1
    ).otherwise(0)


def labelled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past transactions with features and the fraud label, the training table."""
    past = raw_history(spark, sf_dir)
    accounts = _accounts(_past(spark, sf_dir), spark, sf_dir)
    return enrich(past, past, blacklist(spark, sf_dir), accounts).withColumn("isFraud", _label())


def expected_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right answer for each live transaction."""
    return enriched_live(spark, sf_dir).select("tid", _label().alias("isFraud"))


def with_hot_pair(transactions: DataFrame) -> DataFrame:
    """The transactions, every third of them between the same two accounts."""
    third = F.pmod("tid", F.lit(3)) == 0
    named = {"nameOrig": F.when(third, "C0").otherwise(F.col("nameOrig")), "nameDest": F.when(third, "M0").otherwise(F.col("nameDest"))}
    return transactions.withColumns(named)


def learned_rules(spark: SparkSession, sf_dir: str) -> RuleSet:
    """Rules from the history: a larger amount than any before to a destination, and a failure that leaves a balance as a past one did.

    As many rules as there are destinations and different balances; like every rule set they are job configuration and go to the driver.
    """
    past = raw_history(spark, sf_dir)
    largest = past.groupBy("nameDest").agg(F.max(F.col("amount").cast("double")).alias("amount")).orderBy("nameDest")
    balances = past.filter(F.col("type") == "ERROR").select(F.floor("newBalanceOrig").alias("balance")).distinct().orderBy("balance")
    rules: list[Rule | Compound] = []

    def both(first: Rule, second: Rule | Compound) -> Compound:
        return Compound(len(rules), "AND", first, second)

    for row in largest.collect():
        to, more = Rule(-1, "nameDest", "equalTo", row["nameDest"], "string"), Rule(-1, "amount", "greaterThan", repr(row["amount"]), "float")
        rules.append(both(to, more))
    failed = Rule(-1, "type", "equalTo", "ERROR", "string")
    for row in balances.collect():
        low = Rule(-1, "newBalanceOrig", "greaterThanOrEqualTo", str(row["balance"]))
        high = Rule(-1, "newBalanceOrig", "lessThan", str(row["balance"] + 1))
        rules.append(both(failed, both(low, high)))
    return RuleSet(tuple(rules))
