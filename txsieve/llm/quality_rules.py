"""Quality rules: word and line statistics, and a likelihood ratio of hashed n-grams between trusted and all texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import flat, slices, table, text_bytes

N = 4  # bytes in an n-gram
BUCKETS = 1 << 18
SMOOTHING = 0.5
#: The least mean log-likelihood ratio per n-gram (natural logarithm) of a kept text.
LEAST_RATIO = -0.4
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words
# White space between words, symbols that are counted.
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte but the last ``N - 1``: case and punctuation count, digits are alike."""
    if len(data) < N:
        return np.zeros(0, np.int64)
    data = np.where((data >= 48) & (data <= 57), 48, data).astype(np.uint32)
    size = len(data) - N + 1
    code = np.zeros(size, np.uint32)
    for i in range(N):
        code = code * np.uint32(257) + data[i : i + size]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams never reach over the end of a text."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        data, at = flat(batch.column("text"))
        buckets = gram_buckets(data)
        keep = np.ones(len(data), bool)
        for back in range(1, N):
            ends = at[1:] - back
            keep[ends[ends >= 0]] = False
        total += np.bincount(buckets[keep[: len(buckets)]], minlength=BUCKETS)
    has = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(total[has])], ["bucket", "n"])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: summed in each task, then by bucket; the driver gets ``BUCKETS`` numbers."""
    rows = texts.select(text_bytes()).mapInArrow(_count_grams, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def log_ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of the trusted multinomial by the raw one, both with additive smoothing; all 0 without trusted texts."""
    if not trusted.sum() or not raw.sum():
        return np.zeros(BUCKETS, np.float32)
    p, q = trusted + SMOOTHING, raw + SMOOTHING
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


RULES_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
    "base_failed boolean, kept boolean"
)


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """How many words of each text lie in a window of three words that the text holds twice or more."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.fromiter((number[w] for text in words for w in text), np.int64, at[-1])
    covered = np.zeros(len(ids) + 2, bool)
    if len(ids) >= 3:
        text_of = np.repeat(np.arange(len(words)), sizes)
        start = np.flatnonzero(text_of[:-2] == text_of[2:])
        pair = pd.factorize((ids[start] << 32) | ids[start + 1])[0].astype(np.int64)
        window = pd.factorize((pair << 32) | ids[start + 2])[0].astype(np.int64)
        key, _ = pd.factorize((window << 32) | text_of[start])
        twice = start[np.bincount(key)[key] >= 2]
        for step in range(3):
            covered[twice + step] = True
    return _per_text(covered[: len(ids)], at)


def _apply_rules(ratios: np.ndarray, least_ratio: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            data, at = flat(batch.column("text"))
            words = [t.split() for t in texts]
            n_words = np.fromiter(map(len, words), np.int64, len(words))
            in_word = ~SPACE[data] & ((data & 0xC0) != 0x80)
            lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
            repeats = repeated_words(words)
            buckets = gram_buckets(data)
            each = np.concatenate([ratios[buckets], np.zeros(len(data) - len(buckets), np.float32)]).astype(np.float64)
            for back in range(1, N):
                ends = at[1:] - back
                each[ends[ends >= 0]] = 0
            n_grams = np.maximum(np.diff(at) - N + 1, 0)
            ratio = np.where(n_grams > 0, _per_text(each, at) / np.maximum(n_grams, 1), 0.0).round(9)
            failed = (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words),
                    pa.array(_per_text(in_word, at)),
                    pa.array(_per_text(SYMBOL[data], at)),
                    pa.array(np.array([len(x) - len(set(x)) for x in lines], np.int64)),
                    pa.array(repeats),
                    pa.array(ratio),
                    pa.array(failed),
                    pa.array(~failed & (ratio >= least_ratio)),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept"],
            )

    return apply


def trusted_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose labels all mark quality 1. Rows of one id count each; null ids and labels don't match.

    Labels grow with the documents, so both are always dealt by id, at any size.
    """
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("good"))
    return documents.join(good.filter("good = 1").hint("merge"), documents["doc_id"] == F.col("id"), "left_semi")


def apply_rules(documents: DataFrame, trusted: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """The statistics and the verdict for every document.

    ``trusted`` and all of ``documents`` are counted whole into ``BUCKETS`` buckets of byte n-grams. A text's ratio is the mean log ratio of
    its n-grams, 0 without any; texts below ``least_ratio`` aren't kept. Null text is empty, and fails the base rule with all
    texts of under fifty words. Without trusted texts every ratio is 0.
    """
    ratios = log_ratios(gram_counts(trusted), gram_counts(documents))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return texts.mapInArrow(_apply_rules(ratios, least_ratio), RULES_SCHEMA)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(documents, trusted_texts(documents, table(spark, sf_dir, "labels").select("doc_id", "quality")))
