"""What several of the operators need: bounded slices of texts, written intermediate tables, ordered ranges."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.session import new_run_folder

#: Upper-case A-Z to lower case, all other bytes kept.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and a lost executor costs no rework."""
    folder = new_run_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unused(name: str, taken: Iterable[str]) -> str:
    """A column name that isn't among the taken ones."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias("text")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def release_memory() -> None:
    """Give back what earlier tasks of this Python worker have freed, which its allocators may still hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most ``max_bytes`` of text, or of one row where its text alone is longer."""
    release_memory()
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column as one array, and where each value starts (with the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def range_starts(df: DataFrame, column: str, parts: int) -> list[int]:
    """Ascending first values of about equally full ranges of an integer column; ``parts`` bounds their number."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, at, 10 * parts).alias("at")).first()["at"]
    return sorted(set(found or []))


def range_of(column: str, starts: list[int]) -> Column:
    """Which range a value lies in, counted from 0; null values lie in range 0."""
    if not starts:
        return F.lit(0)
    bounds = F.array(*[F.lit(int(s)).cast("long") for s in starts])
    return F.coalesce(F.size(F.filter(bounds, lambda s: s <= F.col(column))), F.lit(0))


def parts_for(df: DataFrame, column: Column, size: int) -> tuple[int, int]:
    """How many parts of about ``size`` the summed column makes, and the sum."""
    total = df.agg(F.sum(column.cast("long")).alias("total")).first()["total"] or 0
    return max(1, math.ceil(total / size)), total


def labelled(
    documents: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, seed: int, most_bytes: int | None = None
) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class, drawn by a seeded hash of doc_id.

    Only labels of ``documents`` are drawn from, and with ``most_bytes`` only those of texts that are no longer. Repeated labels of one
    document count once, as 1 if any is 1, and so do its repeated rows, by their least text; null ids and labels are left out. Only ids are
    moved before the draw; its result has one row an id, so that it can be broadcast.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & allowed)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).filter("doc_id IS NOT NULL")
    if most_bytes is not None:
        texts = texts.filter(F.octet_length("text") <= most_bytes)
    usable = cut(texts.select("doc_id").join(one, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label")), "labelled")
    draws = [
        usable.filter(F.col("label") == value).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    drawn = draws[0].unionByName(draws[1])
    found = texts.join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
