"""Numbers of n-grams, packed by key bucket so that a shuffle moves a few bytes for each."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

from txsieve.llm.common import LOWER

BUCKET_BITS = 8
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z; words are what ASCII white space separates."""
    return text.translate(LOWER).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _ODD[1]
    values = (values ^ (values >> np.uint64(27))) * _ODD[2]
    return values ^ (values >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on, but for the last n - 1."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = mixed(out * _ODD[0] + hashes[i : i + size])
    return out


def pack(values: np.ndarray, n_bytes: int) -> bytes:
    """The low bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes]).tobytes()


def unpack(data: bytes, n_bytes: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, n_bytes)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :n_bytes] = low
    return out.view("<u8").reshape(-1)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, most of which are small: a byte each, and the large ones after them, compressed."""
    large = np.flatnonzero(counts >= 255)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes(), 1)


def unpack_counts(data: bytes, size: int) -> np.ndarray:
    data = zlib.decompress(data)
    counts = np.frombuffer(data, np.uint8, size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", offset=size)
    return counts
