"""Result tables: Parquet folders and database tables, in batch and from a stream's batches."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.config import JobConfig
from txsieve.sinks import commits
from txsieve.sources.tables import jdbc_options, read_jdbc


#: Where merged parts of a table lie; readers of the batches alone pass over it.
_MERGED = "_merged"


def overwrite_table(df: DataFrame, path: str) -> None:
    """Replace the rows of a Parquet table."""
    df.write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Replace a catalog table that lies in buckets of ``keys``, one file each.

    A join on these keys then reads it without a shuffle.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.format("parquet").mode("overwrite").saveAsTable(table)


def overwrite_jdbc(df: DataFrame, config: JobConfig, table: str) -> None:
    """Replace the rows of a database table, keeping the table itself."""
    options = {**jdbc_options(config, table), "truncate": "true"}
    df.write.format("jdbc").options(**options).mode("overwrite").save()


def write_text(messages: DataFrame, path: str) -> None:
    """Replace a text folder by the message values, one a line."""
    messages.select("value").write.mode("overwrite").text(path)


def write_batch(df: DataFrame, batch_id: int, path: str, fmt: str = "parquet") -> None:
    """Write one batch of a stream into its own part of a table of files, and then a row that says it is complete.

    A repeated batch that was complete is left as it is, so that no file changes under a reader; one that wasn't is replaced. Batch 0, the
    first of a new checkpoint, empties the table; a restarted stream goes on with later numbers and keeps it.
    """
    spark = df.sparkSession
    if batch_id == 0:
        nothing = df.limit(0).withColumn("batch_id", F.lit(0)).write.partitionBy("batch_id")
        nothing.option("partitionOverwriteMode", "static").mode("overwrite").format(fmt).save(path)
    elif commits.done(spark, path, ["batch"], batch_id):
        return
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")
    commits.commit(spark, path, "batch", batch_id)


def upsert_detections(batch: DataFrame, batch_id: int, path: str) -> None:
    """Add a batch of ``(tid, isFraud)`` to a Parquet table that :func:`read_detections` reads.

    A batch is written without a look at earlier ones, so that its cost does not grow with the table. Of all rows
    of a ``tid`` the largest ``isFraud`` counts, however the stream is cut into batches.
    """
    write_batch(_one_per_tid(batch), batch_id, path)


def _one_per_tid(batch: DataFrame) -> DataFrame:
    return batch.groupBy("tid").agg(F.max("isFraud").alias("isFraud"))


def _tid_range(fresh: DataFrame) -> tuple[int, int] | None:
    lowest, highest = fresh.agg(F.min("tid"), F.max("tid")).first()
    return None if lowest is None else (lowest, highest)


def _exceeding(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``fresh`` whose ``tid`` is not known with the same or a larger ``isFraud``."""
    same = fresh["tid"].eqNullSafe(known["tid"])
    covered = F.coalesce(known["isFraud"] >= fresh["isFraud"], fresh["isFraud"].isNull())
    return fresh.join(known, same & covered, "left_anti")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``tid`` of a table written by :func:`upsert_detections`, as it was after one of its batches.

    What is complete is looked up first; later batches and later merges are not part of the frame, however long it is used.
    """
    return _one_per_tid(_snapshot(spark, path)[0])


def compact_detections(spark: SparkSession, path: str) -> int | None:
    """Merge the complete batches of a table into one part, and give the last of them; None if no batch is complete.

    The stream may go on meanwhile: its next batches are parts of their own, which readers add to the merged one. The merged part
    counts from the moment its row is written. Readers that started before go on with the batches, which stay where they are; the folders
    of batches up to the number given may be removed once no such reader is left.
    """
    snapshot, upto = _snapshot(spark, path)
    if upto is None:
        return None
    if commits.latest(spark, path, "merged") != upto:
        _one_per_tid(snapshot).write.mode("overwrite").parquet(f"{path}/{_MERGED}/upto={upto}")
        commits.commit(spark, path, "merged", upto)
    return upto


def _snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """The rows of the last merged part and of the complete batches after it, and the last batch among them."""
    merged = commits.latest(spark, path, "merged")
    batches = commits.complete(spark, path, "batch", -1 if merged is None else merged)
    schema = "tid long, isFraud int"
    if batches is None:
        # A table of before there were such rows.
        return spark.read.schema(f"{schema}, batch_id long").parquet(path).select("tid", "isFraud"), None
    # The folders are named, so older ones aren't listed.
    parts = [f"{path}/batch_id={number}" for number in batches]
    if merged is not None:
        parts.append(f"{path}/{_MERGED}/upto={merged}")
    upto = max([*batches, *([] if merged is None else [merged])], default=None)
    if not parts:
        return spark.createDataFrame([], schema), None
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*parts), upto


def upsert_detections_jdbc(
    batch: DataFrame, batch_id: int, config: JobConfig, table: str, partitions: int = 16
) -> None:
    """:func:`upsert_detections` into a database table, where the largest ``isFraud`` of a ``tid`` counts as well.

    Only rows that exceed what the table has for their ``tid`` are added, so a repeated attempt adds nothing.
    """
    fresh = _one_per_tid(batch).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        bounds = _tid_range(fresh)
        if batch_id == 0:
            overwrite_jdbc(fresh, config, table)
        elif bounds:
            low, high = bounds
            split = {"partition_column": "tid", "lower": low, "upper": high, "partitions": partitions}
            known = read_jdbc(fresh.sparkSession, config, table, **(split if low < high else {}))
            known = known.filter(F.col("tid").between(low, high)).select("tid", "isFraud")
            new = _exceeding(fresh, known)
            new.write.format("jdbc").options(**jdbc_options(config, table)).mode("append").save()
    finally:
        fresh.unpersist()
