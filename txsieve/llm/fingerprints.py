"""Context-triggered piecewise hashing of texts, compared by edit distance."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txsieve.llm.common import parts_for, range_of, range_starts, slices, table

WINDOW = 7
SMALLEST_BLOCK = 4
CHUNKS = 32  # a signature has about half of this to all of it
LONGEST = 64
LONG_CHUNK = 4  # block sizes after which a chunk ends anyway, as in texts that repeat themselves
# The base64 letters that signatures are written in.
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
RANGE_BYTES = 16 << 20
MOST_RANGES = 4096


def block_size(n_bytes: int) -> int:
    """The smallest power of two that splits so many bytes into at most ``CHUNKS`` parts on average."""
    size = SMALLEST_BLOCK
    while size * CHUNKS < n_bytes:
        size *= 2
    return size


def fingerprints(texts: Sequence[bytes]) -> list[str]:
    """``block:signature:signature`` of each text, for its block size and the double of it.

    A chunk ends where the hash of the last seven bytes has all low bits set, so an edit changes only the chunks it touches, and
    at the latest after four block sizes.
    A chunk's letter comes from the sum of the rolling hashes in it. Chunks past the 63rd share the last letter. An empty text has
    empty signatures. Equal texts have equal fingerprints, wherever they stand.
    """
    if not texts:
        return []
    pad = bytes(WINDOW)
    data = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint32) + np.uint32(1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + WINDOW) - lengths
    ends = begins + lengths
    rolled = np.zeros(len(data), np.uint32)
    for back in range(WINDOW):
        rolled[back:] += data[: len(data) - back] * np.uint32(pow(0x01000193, back + 1, 1 << 32))
    mixed = rolled.astype(np.uint64) * _MIX
    low = (mixed >> np.uint64(40)).astype(np.uint32)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(29)), dtype=np.uint64)])
    blocks = [block_size(int(n)) for n in lengths]
    gaps = np.append(np.repeat(np.array(blocks, np.uint32) - np.uint32(1), lengths + WINDOW), np.uint32(0))[: len(data)]
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begins, 1)
    np.add.at(inside, ends, -1)
    marks = np.flatnonzero(((low & gaps) == gaps) & (np.cumsum(inside[:-1]) > 0))
    wide = marks[(low[marks] & (2 * gaps[marks] + 1)) == 2 * gaps[marks] + 1]

    def letters(at: np.ndarray, first: int, last: int, begin: int, end: int, most: int) -> str:
        stops = at[first:last] + 1
        if end > begin and (not len(stops) or stops[-1] != end):
            stops = np.append(stops, end)
        spans = np.diff(stops, prepend=begin)
        if len(spans) and spans.max() > most:
            stops = np.unique(np.concatenate([stops, *(np.arange(b - n + most, b, most) for b, n in zip(stops, spans, strict=True) if n > most)]))
        if len(stops) > LONGEST:
            stops = np.append(stops[: LONGEST - 1], end)
        sums = summed[stops]
        sums[1:] -= summed[stops[:-1]]
        sums[:1] -= summed[begin : begin + 1]
        return LETTERS[((sums * _MIX) >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    spans = [np.searchsorted(m, x) for m in (marks, wide) for x in (begins, ends)]
    return [
        f"{blocks[i]}:{letters(marks, spans[0][i], spans[1][i], begins[i], ends[i], LONG_CHUNK * blocks[i])}"
        f":{letters(wide, spans[2][i], spans[3][i], begins[i], ends[i], 2 * LONG_CHUNK * blocks[i])}"
        for i in range(len(texts))
    ]


def edit_distances(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures of at most 64 letters: bit-parallel columns, all pairs at once."""
    n = len(left)
    size = np.fromiter(map(len, left), np.int64, n)
    steps = np.fromiter(map(len, right), np.int64, n)
    place = np.zeros(256, np.int64)
    place[LETTERS] = np.arange(64)

    def coded(words: Sequence[str]) -> np.ndarray:
        out = np.zeros((n, LONGEST), np.uint8)
        for i, word in enumerate(words):
            out[i, : len(word)] = np.frombuffer(word.encode(), np.uint8)
        return place[out]

    a, b = coded(left), coded(right)
    rows = np.arange(n)
    equal = np.zeros((n, 64), np.uint64)
    for i in range(int(size.max(initial=0))):
        has = rows[size > i]
        equal[has, a[has, i]] |= np.uint64(1 << i)
    one = np.uint64(1)
    top = np.maximum(size - 1, 0).astype(np.uint64)
    plus, minus, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), size.copy()
    for j in range(int(steps.max(initial=0))):
        match = equal[rows, b[:, j]]
        vertical = match | minus
        horizontal = (((match & plus) + plus) ^ plus) | match
        up, down = minus | ~(horizontal | plus), plus & horizontal
        change = ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
        score += np.where(steps > j, change, 0)
        up, down = (up << one) | one, down << one
        plus, minus = down | ~(vertical | up), up & vertical
    return np.where(size == 0, steps, score)


def likenesses(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 less the edit distance by the longer signature's length.

    Signatures are compared at the same block size: the first of both, or one's first with the other's second. Others have 0.
    Of more than three equal letters in a row, as repeated text gives, three count.
    Equal fingerprints have 1, empty ones included.
    """
    pairs, same, comparable = [], [], []
    for x, y in zip(left, right, strict=True):
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        x1, x2, y1, y2 = (re.sub(r"(.)\1{3,}", r"\1\1\1", letters) for letters in (x1, x2, y1, y2))
        pairs.append((x1, y1) if bx == by else (x1, y2) if bx == 2 * by else (x2, y1) if by == 2 * bx else ("", ""))
        comparable.append(bx == by or bx == 2 * by or by == 2 * bx)
        same.append(x == y)
    distance = edit_distances([p[0] for p in pairs], [p[1] for p in pairs])
    longest = np.array([max(len(p), len(q)) for p, q in pairs], np.int64)
    like = np.where(np.array(comparable, bool) & (longest > 0), 1 - distance / np.maximum(longest, 1), 0.0)
    return np.where(np.array(same, bool), 1.0, like)


FINGERPRINT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, following = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
        edited = [edited_text(t.decode(), f.decode()).encode() for t, f in zip(texts, following, strict=True)]
        own, changed, after = fingerprints(texts), fingerprints(edited), fingerprints(following)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t.decode()) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(own),
                pa.array(changed),
                pa.array(after),
                pa.array(likenesses(own, changed)),
                pa.array(likenesses(own, after)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "near_edited", "near_next"],
        )


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) as UTF-8, where next is the next in descending doc_id and the first follows the last.

    Ids are put into ranges of about equal size that follow each other; the first row of a range is also sent to the range before it,
    where it ends that range's order. So no task sorts more than a range, and texts are moved once. Null ids come last; rows of
    one id are ordered by text, descending; a lone row follows itself. Null text is empty.
    """
    lowest = -(1 << 63)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("at"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    parts, total = parts_for(documents, F.octet_length("text"), RANGE_BYTES)
    shuffles = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(rows, "at", min(MOST_RANGES, max(parts, shuffles)))
    rows = rows.withColumn("span", range_of("at", starts)).withColumn("borrowed", F.lit(False))
    heads = sorted(((r["span"], r["at"]) for r in rows.groupBy("span").agg(F.max("at").alias("at")).collect()), reverse=True)
    before = [(heads[i - 1][0], at) for i, (_, at) in enumerate(heads)]  # at i = 0 the last range
    spark = documents.sparkSession
    giving = spark.createDataFrame(before, "span int, at long")
    first = rows.drop("span").join(F.broadcast(giving), "at").groupBy("span", "at").agg(F.max("text").alias("text"))
    lent = first.select(F.lit(None).cast("long").alias("doc_id"), "at", "text", "span", F.lit(True).alias("borrowed"))
    order = Window.partitionBy("span").orderBy("borrowed", F.col("at").desc(), F.col("text").desc())
    return (
        rows.unionByName(lent)
        .withColumn("next_text", F.lead("text").over(order))
        .filter(~F.col("borrowed"))
        .select("doc_id", F.col("text").cast("binary").alias("text"), F.col("next_text").cast("binary").alias("next_text"))
    )


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``edited_text``), and how near they and the next document's are."""
    return with_next(documents).mapInArrow(_fingerprint_rows, FINGERPRINT_SCHEMA)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
