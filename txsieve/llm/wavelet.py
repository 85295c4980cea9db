"""Token ids of documents as wavelet matrices: one compressed file a shard, with access, counting and occurrence lookup."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txsieve.llm.bpe import UnitTable, Vocabulary, kept, shared_vocabulary
from txsieve.llm.common import parts_for, range_of, range_starts, slices, table
from txsieve.session import new_run_folder

LEVELS = 16  # bits of a token id
BLOCK = 512  # bits between stored ranks
SHARD_TOKENS = 4 << 20
END = 2
RANGE_BYTES = 16 << 20
MOST_RANGES = 4096
#: What a Python worker's table of encoded units may take; the library itself remembers nothing.
TABLE_BYTES = 160 << 20


class WaveletMatrix:
    """A sequence of ids below 2 ** levels as bit-planes, the highest bit first.

    Each plane has one bit of every id, in an order that puts the ids with a 0 in the plane above before those with a 1. ``ranks`` counts
    the ones before each block of bits, so that a rank takes one table look-up and one block, and a select a search over the blocks.
    """

    def __init__(self, size: int, planes: list[np.ndarray], zeros: Sequence[int], ranks: list[np.ndarray]):
        self.size, self.planes, self.zeros, self.ranks = size, planes, list(zeros), ranks

    @classmethod
    def build(cls, ids: np.ndarray, levels: int = LEVELS) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> levels:
            raise ValueError("an id has more bits than there are levels")
        row = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = ((row >> level) & 1).astype(bool)
            planes.append(np.packbits(bits, bitorder="little"))
            ranks.append(cls._block_ranks(planes[-1]))
            low = np.compress(~bits, row)
            zeros.append(len(low))
            row = np.concatenate([low, np.compress(bits, row)])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _block_ranks(plane: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(plane).astype(np.uint32)
        per_block = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8)) if len(ones) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)

    def _rank(self, level: int, at: int) -> int:
        """Ones before ``at`` in a plane."""
        block = at // BLOCK
        part = self.planes[level][block * (BLOCK // 8) : (at + 7) // 8]
        if not len(part):
            return int(self.ranks[level][block])
        part = part.copy()
        if at % 8:
            part[-1] &= (1 << at % 8) - 1
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Where the nth (from 0) 0 or 1 of a plane is."""
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.size) - ranks
        block = int(np.searchsorted(ranks, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - int(ranks[block])])

    def access(self, at: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][at // 8]) >> at % 8 & 1
            ones = self._rank(level, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            first, last = self._rank(level, start), self._rank(level, end)
            bit = token >> (len(self.zeros) - 1 - level) & 1
            start, end = (zeros + first, zeros + last) if bit else (start - first, end - last)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token occurs in a range of positions."""
        first, last = self._span(token, start, self.size if end is None else end)
        return last - first

    def occurrence(self, token: int, nth: int) -> int:
        """The position of the nth (from 0) occurrence of a token."""
        first, last = self._span(token, 0, self.size)
        if not 0 <= nth < last - first:
            raise IndexError("the token occurs less often")
        at = first + nth
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """Every id in order: the planes are undone from the last to the first."""
        row = np.zeros(self.size, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for depth, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(plane, count=self.size, bitorder="little").astype(bool)
            above = np.empty_like(row)
            above[np.flatnonzero(~bits)] = row[:zeros]
            above[np.flatnonzero(bits)] = row[zeros:] | (1 << depth)
            row = above
        return row


ARCHIVE_SCHEMA = (
    "span int, part int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "levels int, zeros array<long>, planes array<binary>, ranks array<binary>"
)


class LibraryCoder:
    """Encodes units of text with the tokenizers library; units that begin with one space or new line are encoded as one text."""

    def __init__(self, text: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every unit comes once
        sizes = Vocabulary.sizes(text)
        self.size = np.zeros(max(sizes) + 1, np.int64)
        for token, number in sizes.items():
            self.size[token] = number

    def __call__(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(units), np.int64)
        spaced = [u[0] in " \n" and len(u) > 1 and not u[1].isspace() and not u[-1].isspace() for u in units]
        joined = [u for u, s in zip(units, spaced, strict=True) if s]
        encoding = self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0]
        ids = np.array(encoding.ids, np.uint32)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, joined)), np.int64, len(joined)))
        stops = np.searchsorted(np.cumsum(self.size[ids]), ends, side="left") + 1
        if len(joined) and (stops[-1] != len(ids) or int(self.size[ids].sum()) != int(ends[-1])):
            raise ValueError("the units of a text don't encode apart")
        spaced = np.array(spaced, bool)
        counts[spaced] = np.diff(stops, prepend=0)
        others = self.tokenizer.encode_batch_fast([units[i] for i in np.flatnonzero(~spaced)], add_special_tokens=False)
        apart = [e.ids for e in others]
        counts[~spaced] = list(map(len, apart))
        flat, of_spaced = np.empty(int(counts.sum()), np.uint32), np.repeat(spaced, counts)
        flat[of_spaced] = ids
        flat[~of_spaced] = np.fromiter(chain.from_iterable(apart), np.uint32, len(flat) - len(ids))
        return flat, counts


def library_units(text: str) -> UnitTable:
    return UnitTable(LibraryCoder(text), TABLE_BYTES, run=4 << 20)


def _archive_rows(stored):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = kept(stored, library_units)
        span, part, start, held = -1, 0, 0, 0
        pending: list[tuple[np.ndarray, np.ndarray, list]] = []

        def shard() -> pa.RecordBatch:
            nonlocal part, start, held, pending
            ids = np.concatenate([p[0] for p in pending])
            lengths = np.concatenate([p[1] for p in pending])
            matrix = WaveletMatrix.build(ids)
            row = {
                "span": span, "part": part, "start": start, "n_tokens": len(ids), "doc_ids": [d for p in pending for d in p[2]],
                "lengths": lengths.tolist(), "levels": LEVELS, "zeros": matrix.zeros,
                "planes": [p.tobytes() for p in matrix.planes], "ranks": [r.tobytes() for r in matrix.ranks],
            }
            part, start, held, pending = part + 1, start + len(ids), 0, []
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("span", pa.int32()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("lengths", pa.list_(pa.int64())), ("levels", pa.int32()), ("zeros", pa.list_(pa.int64())),
                ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
            ]))

        for whole in slices(batches, max_bytes=4 << 20):
            spans = whole.column("span").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), whole.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                batch = whole.slice(begin, end - begin)
                if spans[begin] != span:
                    if pending:
                        yield shard()
                    span, part, start = int(spans[begin]), 0, 0
                flat, counts = units.encode([t or "" for t in batch.column("text").to_pylist()])
                if len(flat) and int(flat.max()) >> LEVELS:
                    raise ValueError("the vocabulary has ids of more bits than there are levels")
                flat = np.insert(flat.astype(np.uint16), np.cumsum(counts), END)
                pending.append((flat, counts + 1, batch.column("doc_id").to_pylist()))
                held += len(flat)
                if held >= SHARD_TOKENS:
                    yield shard()
        if pending:
            yield shard()

    return rows


def write_archive(documents: DataFrame, folder: str, path: str | None = None) -> None:
    """Encodes every text, adds an end id, and writes shards of about ``SHARD_TOKENS`` ids in ascending order of doc_id.

    Texts are moved once, into ranges of ids that follow each other; a range's rows are sorted in its task and encoded as they come, so
    a task holds no more than a shard. A shard is one file with one wavelet matrix and its documents' ids and lengths; span and
    part give the shards' order and start the ids before a shard in its span. Null ids come first, rows of one id are ordered by
    text, null text is empty. A document is never split.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = documents.sparkSession
    parts, _ = parts_for(documents, F.octet_length("text"), RANGE_BYTES)
    count = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = range_starts(rows, "doc_id", min(MOST_RANGES, count))
    ranged = rows.withColumn("span", range_of("doc_id", starts)).repartition(count, "span").sortWithinPartitions("span", "doc_id", "text")
    shards = ranged.mapInArrow(_archive_rows(shared_vocabulary(spark, path)), ARCHIVE_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def read_matrices(spark, folder: str) -> DataFrame:
    return spark.read.schema(ARCHIVE_SCHEMA).parquet(folder)


def matrix_of(row: dict) -> WaveletMatrix:
    """The matrix of an archive's row; a row read without ranks only gives its ids back whole."""
    planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
    return WaveletMatrix(row["n_tokens"], planes, row["zeros"], [np.frombuffer(r, np.uint32) for r in row.get("ranks") or []])


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
            ids = matrix_of(shard).all().astype("<u4")
            lengths = np.array(shard["lengths"], np.int64)
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard["doc_ids"], pa.int64()),
                    pa.array(shard["before"] + shard["start"] + ends - lengths),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_archive(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone. At most ``MOST_RANGES`` span totals are broadcast."""
    shards = read_matrices(spark, folder)
    totals = shards.groupBy("span").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("span", before.cast("long").alias("before"))
    return shards.join(F.broadcast(offsets), "span").drop("span", "part", "ranks", "levels").mapInArrow(_read_rows, READ_SCHEMA)


def op10_wavelet(spark, sf_dir: str) -> DataFrame:
    folder = new_run_folder(spark, "wavelet")
    write_archive(table(spark, sf_dir, "documents"), folder)
    return read_archive(spark, folder)
