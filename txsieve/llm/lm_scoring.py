"""Language-model scores of texts: smoothed n-grams as a weighted automaton with failure arcs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import crc_mod, slices, table, text_bytes
from txsieve.llm.packing import BUCKET_BITS, grams, hash_words, pack, pack_counts, unpack, unpack_counts, words_of

ORDER = 2
#: Pseudo-count of the shorter context's distribution in every context.
PRIOR = 4.0
BLOCK_TOKENS = 1 << 20
BUCKETS = 1 << BUCKET_BITS
#: Bits of a key and the bytes of it that are moved, as its bucket gives the rest: of single words, and of longer n-grams.
KEYS = ((64, 7), (48, 5))
_END = np.array([0x0E2D0F7E47], np.uint64)


class Block:
    """Documents of a task: their tokens as numbers of distinct words, and the n-grams that these make.

    A text's tokens are its words and one end. ``grams[n - 1]`` has the sorted keys of the distinct n-grams of n words, and
    ``at[n - 1]`` for each token which of them ends there (-1 where a text has fewer tokens so far).
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int):
        self.words, self.tokens, self.lengths = words, tokens, lengths
        hashes = words[tokens] if len(tokens) else np.zeros(0, np.uint64)
        ends = np.cumsum(lengths)
        place = np.arange(len(tokens)) - np.repeat(ends - lengths, lengths)
        self.grams, self.at = [], []
        for n in range(1, order + 1):
            at = np.full(len(tokens), -1, np.int64)
            whole = np.flatnonzero(place >= n - 1)
            keys, at[whole] = np.unique(grams(hashes, n)[whole - n + 1] if n > 1 else hashes, return_inverse=True)
            self.grams.append(keys)
            self.at.append(at)

    @classmethod
    def of(cls, texts: list[bytes], order: int) -> Block:
        parts = [np.append(hash_words(words_of(t)), _END) for t in texts]
        words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        return cls(words, tokens.astype(np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)), order)

    def pack(self) -> bytes:
        """The tokens alone; the words are the single-word keys in their order."""
        planes = np.ascontiguousarray(self.tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        return zlib.compress(planes.tobytes(), 1)

    @classmethod
    def unpack(cls, data: bytes, words: np.ndarray, lengths: np.ndarray, order: int) -> Block:
        planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
        return cls(words, np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64), lengths, order)


_COUNTS = "bucket long, block long, keys binary, counts binary, ids array<long>, held array<boolean>, lengths array<long>, tokens binary"
_COUNT_FIELDS = pa.schema([
    ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())),
    ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()),
])
_NAMES = _COUNT_FIELDS.names[1:]


def _counted(block: Block, held: np.ndarray) -> list[np.ndarray]:
    """How often the documents that aren't held out have each n-gram."""
    learns = np.repeat(~held, block.lengths)
    return [np.bincount(at[learns & (at >= 0)], minlength=len(keys)) for keys, at in zip(block.grams, block.at, strict=True)]


def _kinds(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of single words and of all longer n-grams: (keys in order, which of them each is when counted as they come in the block)."""
    out = []
    for (bits, _), arrays in zip(KEYS, (block.grams[:1], block.grams[1:]), strict=True):
        keys = np.concatenate([np.zeros(0, np.uint64), *arrays]) >> np.uint64(64 - bits)
        order = np.argsort(keys, kind="stable")
        out.append((keys[order], order))
    return out


def _count_rows(order: int, whole: bool):
    """Blocks of documents: for each key bucket the n-grams and their counts, and with ``whole`` a row with the block itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        texts: list[bytes] = []
        ids: list[int | None] = []
        held: list[bool] = []
        tokens = 0

        def emit() -> pa.RecordBatch:
            nonlocal number, texts, ids, held, tokens
            block = Block.of(texts, order)
            counted = _counted(block, np.array(held, bool))
            out = []
            for kind, ((keys, source), counts) in enumerate(zip(_kinds(block), (counted[:1], counted[1:]), strict=True)):
                counts = np.concatenate([np.zeros(0, np.int64), *counts])[source]
                bits, width = KEYS[kind]
                edges = np.searchsorted(keys, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(bits - BUCKET_BITS)).tolist()
                for b, (i, j) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)):
                    if j > i:
                        row = {"bucket": kind * BUCKETS + b, "block": number, "keys": pack(keys[i:j], width), "counts": pack_counts(counts[i:j])}
                        out.append(row)
            if whole:
                out.append({"bucket": -1 - number, "block": number, "ids": ids, "held": held, "lengths": block.lengths.tolist(), "tokens": block.pack()})
            number, texts, ids, held, tokens = number + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist(out, schema=_COUNT_FIELDS)

        for batch in slices(batches):
            for doc_id, is_held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                ids.append(doc_id)
                held.append(is_held)
                texts.append(text)
                tokens += len(text) // 6 + 1
                if tokens >= BLOCK_TOKENS or len(ids) >= 500_000:
                    yield emit()
        if ids:
            yield emit()

    return rows


_ANSWERS = "block long, keys binary, counts binary, ids array<long>, held array<boolean>, lengths array<long>, tokens binary"


def _bucket_sums(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    width = KEYS[rows.column("bucket")[0].as_py() // BUCKETS][1]
    parts = [unpack(k, width) for k in rows.column("keys").to_pylist()]
    keys, number = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.concatenate([unpack_counts(c, len(p)) for c, p in zip(rows.column("counts").to_pylist(), parts, strict=True)])
    return parts, number, np.bincount(number, counts.astype(np.float64), len(keys)).astype(np.int64)


def _answer_rows(rows: pa.Table) -> pa.Table:
    """Of one bucket each n-gram's count over all blocks, given back to every block that asked; the blocks' own rows pass through.

    Single words go back with their keys, which the blocks' own rows lack.
    """
    bucket = rows.column("bucket")[0].as_py()
    if bucket < 0:
        return rows.select(_NAMES)
    parts, number, total = _bucket_sums(rows)
    ends = np.cumsum([len(p) for p in parts])
    words = [b""] * len(parts) if bucket >= BUCKETS else [pack(p, KEYS[0][1]) for p in parts]
    answer = [
        len(p).to_bytes(8, "big") + w + pack_counts(total[number[e - len(p) : e]]) for e, p, w in zip(ends, parts, words, strict=True)
    ]
    named = pa.array([bucket.to_bytes(4, "big")] * rows.num_rows, pa.binary())
    empty = [pa.nulls(rows.num_rows, _COUNT_FIELDS.field(n).type) for n in _NAMES[3:]]
    return pa.table([rows.column("block"), named, pa.array(answer, pa.binary()), *empty], names=_NAMES)


def _size_rows(rows: pa.Table) -> pa.Table:
    _, _, total = _bucket_sums(rows)
    return pa.table({"words": [int(np.count_nonzero(total))], "tokens": [int(total.sum())]})


class Automaton:
    """The part of the model that a block's texts can meet.

    Every n-gram that training has is a state or an arc: a state is the longest run of last tokens that training has, of order - 1 at most. Its arcs
    lead by the tokens that training has after it. On any other token its failure arc leads to the state without its oldest
    token, down to the root, which has an arc for every token. An arc weighs
    log10((c(state, token) + prior * P(token | shorter state)) / (c(state) + prior)), a failure arc log10(prior / (c(state) + prior)); so a
    failure and the arc after it give the same sum with a count of 0, and every state's distribution sums to 1. The root adds one to each count.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], words: int, tokens: int, prior: float):
        self.block, self.counts = block, counts
        size = tokens + words + 1
        self.known = [c > 0 for c in counts]
        chance = (counts[0] + 1) / size
        self.arcs = [np.log10(chance)]
        # A state's count as a context is that of its n-gram, less what ends a text; the end is never a context.
        self.failures = [np.log10(prior / (c + prior)) for c in counts[:-1]]
        for n in range(2, len(counts) + 1):
            # The same token closes the shorter n-gram; where n tokens end, the context ended one token before.
            at, shorter = block.at[n - 1], block.at[n - 2]
            has = np.flatnonzero(at >= 0)
            context = np.zeros(len(block.grams[n - 1]), np.int64)
            context[at[has]] = block.at[n - 2][has - 1]
            lower = np.zeros(len(block.grams[n - 1]))
            lower[at[has]] = chance[shorter[has]]
            chance = (counts[n - 1] + prior * lower) / (counts[n - 2][context] + prior)
            self.arcs.append(np.log10(chance))

    def scores(self) -> np.ndarray:
        """Log10 probability of each text: one pass from its first token to its end that carries the state and adds up arcs."""
        order = len(self.counts)
        arcs = [self._steps(a, at) for a, at in zip(self.arcs, self.block.at, strict=True)]
        known = [self._steps(k, at) for k, at in zip(self.known, self.block.at, strict=True)]
        failures = [self._steps(f, at) for f, at in zip(self.failures, self.block.at, strict=False)]
        out, at = [], 0
        for length in self.block.lengths.tolist():
            total, state = 0.0, 0  # the state is the number of last tokens that it holds
            for at in range(at, at + length):
                while state and not known[state][at]:
                    total += failures[state - 1][at - 1]
                    state -= 1
                total += arcs[state][at]
                state = min(state + 1, order - 1) if known[state][at] else 0
            at += 1
            out.append(total)
        return np.array(out)

    @staticmethod
    def _steps(values: np.ndarray, at: np.ndarray) -> list:
        return np.where(at >= 0, values[at], 0).tolist()


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_rows(order: int, words: int, tokens: int, prior: float):
    def scores(rows: pa.Table) -> pa.Table:
        head = rows.filter(pc.is_valid(rows.column("tokens")))
        lengths = np.array(head.column("lengths")[0].as_py(), np.int64)
        answers = rows.filter(pc.is_valid(rows.column("counts")))
        words_, found = [], []
        for name, data in sorted(zip(answers.column("keys").to_pylist(), answers.column("counts").to_pylist(), strict=True)):
            bucket, size = int.from_bytes(name, "big"), int.from_bytes(data[:8], "big")
            end = 8
            if bucket < BUCKETS:
                end += KEYS[0][1] * size
                words_.append(unpack(data[8:end], KEYS[0][1]) | np.uint64(bucket << 64 - BUCKET_BITS))
            found.append(unpack_counts(data[end:], size))
        block = Block.unpack(head.column("tokens")[0].as_py(), np.concatenate(words_), lengths, order)
        sources = [source for _, source in _kinds(block)]
        counts = np.empty(sum(map(len, found)), np.int64)
        counts[np.concatenate([sources[0], len(sources[0]) + sources[1]])] = np.concatenate(found)
        counts = np.split(counts, np.cumsum([len(g) for g in block.grams])[:-1])
        automaton = Automaton(block, counts, words, tokens, prior)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        own = counts[0][block.at[0]]
        base = [float(np.log10((own[i:j] + 1) / (tokens + words + 1)).sum()) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        known = np.concatenate([[0], np.cumsum(own > 0)])
        n = len(lengths)
        return pa.table(
            [
                pa.array(head.column("ids")[0].as_py(), pa.int64()),
                pa.array(head.column("held")[0].as_py(), pa.bool_()),
                pa.array(lengths),
                pa.array(known[edges[1:]] - known[edges[:-1]]),
                pa.array([tokens] * n, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(automaton.scores()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return scores


def score_documents(documents: DataFrame, held_out: Column, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """One row a document: its log10 probability under a model of n-grams up to ``order``, learned from the rows that ``held_out`` is false for.

    The model is as large as the corpus, so no task holds it. A task packs the distinct n-grams of about a million tokens and their counts by
    key bucket; each bucket sums its n-grams over all tasks and gives every block the counts of its own. With them a block builds the part of the automaton
    that its texts can meet. Frequent n-grams come once from each block, so none is a hot key. Words are told apart by 64 bits of their hash,
    longer n-grams by 48.
    Null and empty texts have one token, the end; base_score takes the counts alone. Rows with equal ids each count and get a row.
    Without rows to learn from, every token is unknown and has probability 1.
    """
    if order < 1:
        raise ValueError("an order is 1 or more")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_bytes())
    single = texts.filter(~F.col("held_out")).mapInArrow(_count_rows(1, False), _COUNTS)
    sums = single.groupBy("bucket").applyInArrow(_size_rows, "words long, tokens long").agg(F.sum("words"), F.sum("tokens")).first()
    words, tokens = (int(x or 0) for x in sums)
    answers = texts.mapInArrow(_count_rows(order, True), _COUNTS).groupBy("bucket").applyInArrow(_answer_rows, _ANSWERS)
    return answers.groupBy("block").applyInArrow(_score_rows(order, words, tokens, prior), SCORE_SCHEMA)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
