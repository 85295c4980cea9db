"""Mixing sources to target weights, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txsieve.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn. They share the sum of all sizes by weight; no target
    exceeds ``most`` times its source's size, and what is cut off is shared again by weight among the others. The sources
    reach their limits in the order of limit / weight, so the share per weight that results is found by running sums over that
    order instead of by repeated passes. A table of sources is small (one row each); a source without words has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(1))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("most", F.col("source_size") * most)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(earlier), F.lit(0)))
        .withColumn("share", F.col("left") / F.sum("weight").over(later))
        .withColumn("level", F.min(F.when(F.col("share") <= F.col("ratio"), F.col("ratio"))).over(every))
        .withColumn("share", F.max(F.when(F.col("ratio") == F.col("level"), F.col("share"))).over(every))
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("share") * F.col("weight")))
        .select("source", "source_size", F.coalesce("target", F.col("most").cast("double")).alias("target"))
    )


def copies(key: str, rate: Column, seed: str) -> Column:
    """floor(rate), and one more with the probability of the fraction: 48 bits of a seeded MD5 of the key decide."""
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def plan_mix(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = "mix", key: str = "doc_id"
) -> DataFrame:
    """All columns of ``documents`` with mix_size, mix_source_size, mix_target and mix_copies, which it has no columns of its own for; see :func:`mix`.

    Null text and text without words have size 0; null is a source of its own. Rows with one ``key`` draw alike, so reruns agree. A source's sizes are summed before anything is moved; its one row then meets the documents in
    a join that adaptive execution broadcasts or splits, so that a hot source is not one task's work. An empty table gives no rows.
    """
    sized = documents.withColumn("mix_size", n_words())
    per_source = sized.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    goal = targets(per_source, weights, most).select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    return (
        sized.join(goal, F.col("source").eqNullSafe(F.col("mix_source")), "left")
        .withColumn("mix_copies", F.least(F.lit(most), copies(key, rate, seed)))
        .drop("mix_source")
    )


def row_keys(documents: DataFrame) -> DataFrame:
    """The documents with mix_key: doc_id and a hash of the text, and for rows that have both in common a number of each row's own.

    Ids and hashes alone are counted; the few that repeat are written, so that the join with the texts can broadcast them. The numbers follow
    the order in which the input is read; rows that don't repeat keep their keys however that is.
    """
    hashed = documents.select(
        "*",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix_id"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("mix_hash"),
        F.monotonically_increasing_id().alias("mix_row"),
    )
    count = hashed.groupBy("mix_id", "mix_hash").agg(F.count("*").alias("mix_n")).filter("mix_n > 1")
    joined = hashed.join(cut(count, "mix-repeated"), ["mix_id", "mix_hash"], "left")
    return joined.select(
        *[hashed[c] for c in documents.columns], F.concat_ws(":", "mix_id", "mix_hash", F.when(F.col("mix_n").isNotNull(), F.col("mix_row"))).alias("mix_key")
    )


def mix(documents: DataFrame, **how) -> DataFrame:
    """The mixed documents: each row of ``documents`` as often as the plan says, with its own columns only, whatever their names. Each row draws by itself."""
    whole = F.struct(*[F.col(f"`{name}`") for name in documents.columns]).alias("mix_document")
    packed = documents.select(whole, "doc_id", "source", "text")
    planned = plan_mix(row_keys(packed), key="mix_key", **how).filter(F.col("mix_copies") > 0)
    repeated = planned.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return repeated.select("mix_document.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan_mix(row_keys(documents), key="mix_key").select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


#: The same for DuckDB. Strings compare there by their UTF-8 bytes too, that is by code point.
OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, name || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN ':' || row_number() OVER (PARTITION BY name) ELSE '' END AS key FROM sized
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         source_size * 3 AS most FROM per_source
), shared AS (
  SELECT *, most::DOUBLE / weight AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source ASC NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM shared
), chosen AS (
  SELECT share FROM levels WHERE share <= ratio ORDER BY ratio, share DESC LIMIT 1
), goals AS (
  SELECT source, source_size, least(most::DOUBLE, (SELECT share FROM chosen) * weight) AS target FROM levels
), planned AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || s.key), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM keyed s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (least(3, floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM planned
"""
