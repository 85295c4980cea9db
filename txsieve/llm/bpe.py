"""Byte-pair encoding and decoding with a given vocabulary: distinct words meet in a trie whose states are last tokens."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import slices, table

# Fixed value: the pre-tokenisation pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes, counted as below, that a Python worker's table of units may take before it starts again with none; and as many again for what a vocabulary learns.
TABLE_BYTES = 48 << 20
#: Texts are encoded in runs of about this many characters, so that what one run adds to the table is bounded too.
RUN_CHARACTERS = 1 << 19
_UNIT_COST = 200
_FACT_COST = 100
_NEVER = 1 << 60


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, the merges by rank, and which pairs of tokens can stand side by side."""

    def __init__(self, text: str):
        stored = json.loads(text)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in stored["model"]["vocab"].items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        vocab = stored["model"]["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(stored["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (vocab[left], vocab[right])
            self.rank.setdefault(pair, rank)
            made.setdefault(vocab[left + right], (*pair, rank))
        # How the last and the first byte of a token grow into it: (piece, rank of the merge that takes the piece up).
        self.ending: dict[int, list[tuple[int, int]]] = {}
        self.starting: dict[int, list[tuple[int, int]]] = {}
        self.id_of: dict[bytes, int] = {}
        for token in sorted(vocab.values(), key=lambda t: len(self.bytes_of[t])):
            if len(self.bytes_of[token]) == 1:
                self.ending[token] = self.starting[token] = [(token, _NEVER)]
                self.id_of[self.bytes_of[token]] = token
            elif token in made:
                left, right, rank = made[token]
                if left in self.ending and right in self.ending and self.clash(left, right) == rank:
                    self.ending[token] = [*self.ending[right][:-1], (right, rank), (token, _NEVER)]
                    self.starting[token] = [*self.starting[left][:-1], (left, rank), (token, _NEVER)]
                    self.id_of[self.bytes_of[token]] = token
        self.fits: dict[int, bool] = {}
        # Suffixes that can still grow into a token, numbered as they are met: the next one for each byte, and the tokens that end there.
        self.beginnings = {t[:n] for t in self.id_of for n in range(1, len(t) + 1)}
        self.suffixes: list[bytes] = [b""]
        self.suffix_number: dict[bytes, int] = {b"": 0}
        self.steps: dict[int, int] = {}
        self.ends: list[list[tuple[int, int]]] = [[]]

    @staticmethod
    def sizes(text: str) -> dict[int, int]:
        """How many bytes each token stands for."""
        stored = json.loads(text)
        return {i: len(t) for t, i in stored["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in stored["added_tokens"]}

    def clash(self, left: int, right: int) -> int | None:
        """The rank of the first merge across the border of two tokens when their bytes are encoded together, if there is one.

        Both sides grow by their own merges in the order of rank. A merge across the border happens where the two pieces that
        touch can merge before either is taken up; of equal ranks the one further left comes first.
        """
        a, b = self.ending[left], self.starting[right]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.rank.get((x, y))
            if across is not None and across < x_until and across <= y_until:
                return across
            if x_until == y_until == _NEVER:
                return None
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _step(self, suffix: int, byte: int) -> int:
        """The longest suffix, of a known one and one more byte, with which a token begins."""
        grown = self.suffixes[suffix] + bytes((byte,))
        while grown and grown not in self.beginnings:
            grown = grown[1:]
        found = self.suffix_number.get(grown)
        if found is None:
            found = self.suffix_number[grown] = len(self.suffixes)
            self.suffixes.append(grown)
            tails = (grown[i:] for i in range(len(grown)))
            self.ends.append([(self.id_of[t], len(t)) for t in tails if t in self.id_of])
        self.steps[suffix << 8 | byte] = found
        return found

    def encode_words(self, words: Sequence[bytes]) -> list[list[int]]:
        """The tokens of each word. Words are visited in the depth-first order of their trie, which sorting gives.

        The state of a prefix is the last token of its encoding: the one token that ends there and can stand after the state at which it begins.
        A prefix that words share gets its state once; a word's encoding is read back from its states.
        """
        out: list[list[int]] = [[] for _ in words]
        fits, steps, ends = self.fits, self.steps, self.ends
        states, sizes, suffixes = [-1], [0], [0]
        before = b""
        for index in sorted(range(len(words)), key=words.__getitem__):
            word = words[index]
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], sizes[shared + 1 :], suffixes[shared + 1 :]
            suffix = suffixes[shared]
            for end in range(shared, len(word)):
                byte = word[end]
                after = steps.get(suffix << 8 | byte)
                suffix = self._step(suffix, byte) if after is None else after
                for token, size in ends[suffix]:
                    if size <= end:
                        pair = states[end + 1 - size] << 32 | token
                        fit = fits.get(pair)
                        if fit is None:
                            fit = fits[pair] = self.clash(states[end + 1 - size], token) is None
                        if not fit:
                            continue
                    states.append(token)
                    sizes.append(size)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                suffixes.append(suffix)
            before = word
            at, tokens = len(word), out[index]
            while at:
                tokens.append(states[at])
                at -= sizes[at]
            tokens.reverse()
        if (len(fits) + len(steps) + 3 * len(self.suffixes)) * _FACT_COST > TABLE_BYTES:
            self._forget()
        return out

    def _forget(self) -> None:
        """Starts again without what was found out about pairs of tokens and about suffixes."""
        self.fits.clear()
        self.steps.clear()
        self.suffixes[1:], self.ends[1:] = [], []
        self.suffix_number = {b"": 0}

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class TrieCoder:
    """Encodes units of text with a ``Vocabulary``: special tokens first, then the words of the pattern, each distinct one once."""

    def __init__(self, text: str):
        self.vocabulary = Vocabulary(text)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.names = special
        self.words = regex.compile(PATTERN)

    def pieces(self, unit: str) -> list[str]:
        if not any(name in unit for name in self.names):
            return self.words.findall(unit)
        return [
            piece
            for part in self.special.split(unit)
            for piece in ([part] if part in self.vocabulary.special else self.words.findall(part))
        ]

    def __call__(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the units, one after the other, and how many each has."""
        text = "".join(units)
        split = list(map(self.pieces if any(name in text for name in self.names) else self.words.findall, units))
        tokens = {content: [i] for content, i in self.vocabulary.special.items()}
        words = list(set(chain.from_iterable(split)).difference(tokens))
        tokens.update(zip(words, self.vocabulary.encode_words([w.encode() for w in words]), strict=True))
        found = [tokens[p[0]] if len(p) == 1 else [t for piece in p for t in tokens[piece]] for p in split]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts


class UnitTable:
    """Encodes texts by their distinct units, which are encoded once each.

    A unit is white space and the other characters up to the next white space. No pattern word, merge or special token reaches from a character into
    the white space after it, so a text's encoding is that of its units one after the other. The table only saves work: beyond ``most_bytes`` it
    starts again with none, and it is tested after each run of ``RUN_CHARACTERS``, within a text too.
    """

    def __init__(self, encode_units: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], most_bytes: int = TABLE_BYTES, run: int | None = None):
        self.encode_units, self.most_bytes, self.run = encode_units, most_bytes, run
        self.odd = regex.compile(r"\s[ \n]")
        self.units = regex.compile(r"\s*\S+|\s+")
        self.border = regex.compile(r"\S(?=\s)")
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.counts, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes = 0

    def _keys(self, text: str) -> list[str]:
        """Units after one space are named without it, those from a new line on as they are, others with a space before them."""
        if self.odd.search(text):
            units = self.units.findall(text)
            return [u if u[0] == "\n" else u[1:] if u[0] == " " and len(u) > 1 and not u[1].isspace() else " " + u for u in units]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = " " + keys[0]
        return keys if keys[0] != " " else keys[1:]

    def _runs(self, texts: Sequence[str]) -> Iterator[tuple[list[str], bool]]:
        """Consecutive texts of bounded length together, and whether the last one ends with them; a longer text in parts that end where a unit does."""
        held, size, most = [], 0, self.run or RUN_CHARACTERS
        for text in texts:
            start = 0
            while len(text) - start > most:
                border = self.border.search(text, start + most)
                if not border:
                    break
                yield [*held, text[start : border.end()]], False
                held, size, start = [], 0, border.end()
            held.append(text[start:] if start else text)
            size += len(held[-1])
            if size > most:
                yield held, True
                held, size = [], 0
        if held:
            yield held, True

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, one text after the other, and how many each has."""
        found, totals, open_text = [np.zeros(0, np.uint32)], [], False
        for run, ends in self._runs(texts):
            flat, counts = self._encode_run(run)
            found.append(flat)
            if open_text:
                totals[-1] += int(counts[0])
                counts = counts[1:]
            totals += counts.tolist()
            open_text = not ends
        return np.concatenate(found), np.array(totals, np.int64)

    def _encode_run(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.bytes > self.most_bytes:
            self._forget()
        keys = [self._keys(t) for t in texts]
        known = len(self.number)
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        codes = np.fromiter(map(self.number.__getitem__, chain.from_iterable(keys)), np.int64, int(sizes.sum()))
        del keys
        if len(self.number) > known:
            fresh = [k if k[:1] == "\n" else k[1:] if k[:1] == " " else " " + k for k in islice(self.number, known, None)]
            flat, counts = self.encode_units(fresh)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
            self.bytes += _UNIT_COST * len(fresh) + sum(map(len, fresh)) + 4 * len(flat)
        each = self.counts[codes]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[codes] - ends + each, each)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        totals = np.concatenate([[0], ends])[bounds]
        return self.flat[at], np.diff(totals)


def trie_units(text: str) -> UnitTable:
    return UnitTable(TrieCoder(text))


def kept(stored, build: Callable[[str], UnitTable]) -> UnitTable:
    """What ``build`` makes of a broadcast vocabulary, made once for all tasks of a Python worker.

    A worker keeps the broadcast's dictionary from task to task. The table in it only saves work: it has a bound, and any worker can make it anew.
    """
    made = stored.value
    if build.__name__ not in made:
        made[build.__name__] = build(made["text"])
    return made[build.__name__]


CODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoded(stored):
    """Batches with a text column to (batch, tokens of each text), slice by slice."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, TrieCoder, list[np.ndarray]]]:
        units = kept(stored, trie_units)
        coder = units.encode_units
        for batch in slices(batches, max_bytes=4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            flat, counts = units.encode(texts)
            yield batch, coder, np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []

    return each


def _digest_rows(stored):
    encoded = _encoded(stored)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, coder, ids in encoded(batches):
            decoded = [coder.vocabulary.decode(i.tolist()).encode() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digests


def _id_rows(stored):
    encoded = _encoded(stored)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, ids in encoded(batches):
            column = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "ids"])

    return rows


def _text_rows(stored):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept(stored, trie_units).encode_units.vocabulary
        for batch in batches:
            texts = [vocabulary.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows


def shared_vocabulary(spark, path: str | None = None):
    """The vocabulary file's text as a broadcast of its fixed size, so that executors need no copy of the file; see :func:`kept`."""
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast({"text": file.read()})


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, ids): the token ids of every whole text, null text as empty. Texts aren't moved between tasks."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_id_rows(shared_vocabulary(documents.sparkSession, path)), "doc_id long, text string, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the text of every list of ids, null as none; bytes that aren't UTF-8 become U+FFFD."""
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(_text_rows(shared_vocabulary(encoded.sparkSession, path)), "doc_id long, ids array<int>, decoded string")


def code_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every text and decodes its ids again: one row a document with the digests of both. Null text is empty."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_digest_rows(shared_vocabulary(documents.sparkSession, path)), CODED_SCHEMA)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return code_digests(table(spark, sf_dir, "documents"))
