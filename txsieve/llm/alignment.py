"""Two tokenizers' tokens of the same text side by side: the smallest groups that cover the same bytes, and which ids meet how often."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsieve.llm.bpe import byte_letters, vocabulary_path
from txsieve.llm.common import cut, slices, table

# Fixed value: the letter that stands for a space in pieces.
SPACE = "▁"
BLOCK_BYTES = 8 << 20
#: What a worker's table of units may take, counted as below, before it starts again with none.
TABLE_BYTES = 64 << 20
FRESH = 20_000
_UNIT_COST = 260


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The last token of each token's component, tokens of A first, where both sides' tokens end at these ascending offsets of the same bytes.

    Every token points to the token that reaches farthest to the right of those it overlaps, itself included; of two that end together
    B's. Successors are doubled until nothing changes, which takes as many rounds as the logarithm of the longest chain.
    """
    size = len(a_end)
    farthest_b = np.searchsorted(b_end, a_end)
    farthest_a = np.searchsorted(a_end, b_end)
    own = np.arange(len(b_end))
    ends_together = a_end[farthest_a] == b_end if size else np.zeros(0, bool)
    after = np.concatenate([size + farthest_b, np.where(ends_together, size + own, farthest_a)])
    while True:
        doubled = after[after]
        if np.array_equal(doubled, after):
            return after
        after = doubled


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes overlap, as numbers of A's and of B's tokens, in order; and neither list is longer than both sides together."""
    starts = np.concatenate([np.zeros(1, np.int64), a_end])[: len(a_end)]
    first = np.searchsorted(b_end, starts, side="right")
    sizes = np.searchsorted(b_end, a_end) - first + 1
    ends = np.cumsum(sizes)
    left = np.repeat(np.arange(len(a_end)), sizes)
    return left, np.arange(len(left)) - np.repeat(ends - sizes, sizes) + np.repeat(first, sizes)


class Tokenizers:
    """Both vocabularies: A byte-level, B of pieces that adds a space before a text. Special tokens' strings are plain text."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        stored, letters = json.loads(byte_level), byte_letters()
        self.a_bytes = [b""] * (max([*stored["model"]["vocab"].values(), *(t["id"] for t in stored["added_tokens"])]) + 1)
        for token, i in stored["model"]["vocab"].items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token in stored["added_tokens"]:
            self.a_bytes[token["id"]] = token["content"].encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes((int(name[3:5], 16),)) if self.b.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)
        ]
        self.a_size = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        self.b_space = self.b.piece_to_id(SPACE)
        self.splits = self._splits(stored, [n for i, n in enumerate(names) if not self.b.is_byte(i)])

    def _splits(self, stored: dict, names: list[str]) -> bool:
        """Whether neither tokenizer has a token from another character into a space or line end after it, nor changes a text beforehand."""
        before = stored["pre_tokenizer"] or {}
        plain = stored["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        across = regex.compile(rf"[^{SPACE}]{SPACE}|.\n|\n.", regex.DOTALL)
        sample = " x  ½ﬁ \n\t"
        kept = b"".join(self.b_bytes[i] for i in self.b.encode(sample)) == (" " + sample).encode()
        return bool(plain and kept and not any(across.search(name) for name in names))

    def encode(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of all units, one after the other, and how many each unit has, then B's; none where a side's bytes aren't the unit's.

        A unit starts with a space or, within a text, a line end. Units that end in neither are encoded as one text.
        """
        together = [self.splits and SPACE not in u and not u[-1].isspace() for u in units]
        joined = "".join(u for u, t in zip(units, together, strict=True) if t)
        sizes = np.fromiter((len(u.encode()) for u, t in zip(units, together, strict=True) if t), np.int64)
        found = self._apart([u for u, t in zip(units, together, strict=True) if not t])
        at = np.array(together, bool)
        out = []
        for side, rest in zip((self._a_ids, self._b_ids), found, strict=True):
            ids, size, names = side(joined)
            ends, stops = np.cumsum(size[ids]), np.cumsum(sizes)
            last = np.searchsorted(ends, stops)
            if b"".join(map(names.__getitem__, ids.tolist())) != joined.encode() or len(ids) and (ends[last] != stops).any():
                raise ValueError("the units of a text don't encode apart")
            counts = np.zeros(len(units), np.int64)
            counts[at], counts[~at] = np.diff(last + 1, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))
            flat, of_joined = np.zeros(int(counts.sum()), np.int64), np.repeat(at, counts)
            flat[of_joined], flat[~of_joined] = ids, [i for one in rest for i in one]
            out += [flat, counts]
        return tuple(out)

    def _a_ids(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), self.a_size, self.a_bytes

    def _b_ids(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        # B adds a space itself: the text's own is left out, and before a line end the added one is taken off.
        ids = self.b.encode(text[1:]) if text[:1] == " " else self.b.encode(text)[1:]
        return np.array(ids, np.int64), self.b_size, self.b_bytes

    def _apart(self, units: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = [self._b_ids(u)[0].tolist() or [self.b_space] for u in units]
        for k, unit in enumerate(units):
            whole = unit.encode()
            if b"".join(map(self.a_bytes.__getitem__, a[k])) != whole or b"".join(map(self.b_bytes.__getitem__, b[k])) != whole:
                a[k], b[k] = [], []
        return a, b


class UnitTable:
    """What each distinct unit of text adds to its documents: tokens, groups, links.

    A unit is a space or line end after another character, and all up to the next such place. Where no token of either side reaches over such
    a place, both sides have a token end there, so no group does either, and a document's groups are its units' one after the other.
    """

    def __init__(self, byte_level: str, pieces: bytes):
        self.coders = Tokenizers(byte_level, pieces)
        width = max(len(self.coders.a_bytes), len(self.coders.b_bytes))
        self.width, self.shown = width, [f"{i}{mark}" for mark in ",|;" for i in range(width)]
        self.odd = regex.compile(r"\s[ \n]")
        self.cut_at = regex.compile(r"(?<=\S)(?=[ \n])")
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.groups: list[str] = []
        self.links = np.zeros(0, np.int64)
        # Of each unit: tokens of A, tokens of B, groups, links; whether both sides give its bytes.
        self.sizes, self.valid = np.zeros((4, 0), np.int64), np.zeros(0, bool)
        self.bytes = 0

    def units(self, text: str) -> list[str]:
        """The units of a space and the text. Those after one space are named without it, those from a line end on as they are, others with one more."""
        if not self.coders.splits:
            return ["  " + text]
        if self.odd.search(" " + text):
            found = self.cut_at.split(" " + text)
            return [u if u[0] == "\n" else u[1:] if len(u) > 1 and not u[1].isspace() else " " + u for u in found]
        return text.replace("\n", " \n").split(" ")

    def codes(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The numbers of each text's units, all of which the table knows afterwards."""
        if self.bytes > TABLE_BYTES:
            self._forget()
        known = len(self.number)
        out = []
        for text in texts:
            units = self.units(text) if text else []
            out.append(np.fromiter(map(self.number.__getitem__, units), np.uint32, len(units)))
        fresh = [u if u[:1] == "\n" else u[1:] if u[:1] == " " else " " + u for u in islice(self.number, known, None)]
        for start in range(0, len(fresh), FRESH):
            self._learn(fresh[start : start + FRESH])
        return out

    def _learn(self, fresh: list[str]) -> None:
        a_ids, n_a, b_ids, n_b = self.coders.encode(fresh)
        a_end, b_end = np.cumsum(self.coders.a_size[a_ids]), np.cumsum(self.coders.b_size[b_ids])
        last = terminals(a_end, b_end)
        closes = last[len(a_ids) :] == len(a_ids) + np.arange(len(b_ids))
        b_unit, a_unit = np.repeat(np.arange(len(fresh)), n_b), np.repeat(np.arange(len(fresh)), n_a)
        left, right = overlaps(a_end, b_end)
        sizes = np.stack([n_a, n_b, np.bincount(b_unit[closes], minlength=len(fresh)), np.bincount(a_unit[left], minlength=len(fresh))])
        group = np.searchsorted(np.flatnonzero(closes) + len(a_ids), last)
        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side = group[order], side[order]
        ends = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)[: len(order)]
        marks = np.where(ends, 1 + side, 0)
        shown = list(map(self.shown.__getitem__, (np.concatenate([a_ids, b_ids])[order] + marks * self.width).tolist()))
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = ["".join(shown[begin:end]) for begin, end in zip(bounds, bounds[1:], strict=False)]
        self.groups += groups
        self.links = np.concatenate([self.links, a_ids[left] << 32 | b_ids[right]])
        self.sizes = np.concatenate([self.sizes, sizes], axis=1)
        self.valid = np.concatenate([self.valid, n_a > 0])
        self.bytes += len(fresh) * _UNIT_COST + sum(map(len, fresh)) + sum(map(len, groups)) + 8 * len(left)

    def digest(self, codes: np.ndarray) -> str:
        """The hash of a document's groups, but for the mark after the last."""
        found = hashlib.sha256()
        for start in range(0, len(codes), 1 << 18):
            some = "".join(map(self.groups.__getitem__, codes[start : start + (1 << 18)].tolist()))
            found.update((some if start + (1 << 18) < len(codes) else some[:-1]).encode())
        return found.hexdigest()

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some units, one unit after the other, and how many each has."""
        ends = np.cumsum(self.sizes[3])
        each = self.sizes[3][units]
        stops = np.cumsum(each)
        return self.links[np.arange(stops[-1] if len(stops) else 0) + np.repeat(ends[units] - stops, each)], each


def _kept(stored) -> UnitTable:
    """The worker's table, made once for all its tasks; it only saves work."""
    made = stored.value
    if "units" not in made:
        made["units"] = UnitTable(made["byte_level"], made["pieces"])
    return made["units"]


def shared_tokenizers(spark, byte_level: str | None = None, pieces: str | None = None):
    """Both vocabulary files' contents as a broadcast of their fixed size, so that executors need no copies of the files."""
    with open(byte_level or vocabulary_path(), encoding="utf-8") as a, open(pieces or pieces_path(), "rb") as b:
        return spark.sparkContext.broadcast({"byte_level": a.read(), "pieces": b.read()})


def _packed(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


_BLOCK_FIELDS = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())), ("units", pa.list_(pa.int64())),
    ("codes", pa.binary()), ("link_sizes", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
_BLOCKS = (
    "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "units array<long>, codes binary, link_sizes binary, links binary, pairs array<long>, counts array<long>"
)


def _block_rows(stored):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, max_bytes=BLOCK_BYTES):
            known = _kept(stored)
            codes = known.codes([t or "" for t in batch.column("text").to_pylist()])
            codes = [c if known.valid[c].all() else c[:0] for c in codes]
            lengths = np.fromiter(map(len, codes), np.int64, len(codes))
            used, local = np.unique(np.concatenate([np.zeros(0, np.uint32), *codes]), return_inverse=True)
            owner = np.repeat(np.arange(len(codes)), lengths)
            sums = [_sums(known.sizes[k][used][local], owner, len(codes)) for k in range(4)]
            links, sizes = known.links_of(used)
            pairs, at = np.unique(links, return_inverse=True)
            counts = _sums(np.repeat(np.bincount(local, minlength=len(used)), sizes), at, len(pairs))
            row = {
                "block": block, "ids": batch.column("doc_id").to_pylist(),
                **{name: sums[k].tolist() for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                "digests": [known.digest(c) if len(c) else "" for c in codes], "units": lengths.tolist(), "codes": _packed(local),
                "link_sizes": _packed(sizes), "links": _packed(at), "pairs": pairs, "counts": counts,
            }
            block += 1
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _BLOCK_FIELDS], schema=_BLOCK_FIELDS)

    return rows


def _sums(values: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """The exact sum of the values of each key."""
    out = np.zeros(size, np.int64)
    np.add.at(out, keys, values)
    return out


def aligned_blocks(documents: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """Every whole text aligned, written as blocks of documents of about ``BLOCK_BYTES`` of text; texts aren't moved between tasks.

    A block has its documents' token, group and link numbers and the digest of their groups, and names by position which of the block's distinct pairs of
    ids its links are. Null and empty texts and those that a side's tokens don't give back have none. Ids may be null or repeat.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stored = shared_tokenizers(documents.sparkSession, byte_level, pieces)
    return cut(rows.mapInArrow(_block_rows(stored), _BLOCKS), "aligned")


def id_links(blocks: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, best): how many links hold the two ids linked, in all blocks, and whether no other partner of the B id has more.

    Blocks' pairs are added up before and after the shuffle. Only the highest count of each B id is broadcast, a row for each
    entry of B's vocabulary at most.
    """
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    total = cut(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")), "id-links")
    total = total.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b_id"), "n")
    highest = total.groupBy("b_id").agg(F.max("n").alias("highest"))
    return total.join(F.broadcast(highest), "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("highest")).alias("best"))


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            value = lambda name: row.column(name)[0].as_py()  # noqa: B023, E731
            numbers = lambda name: row.column(name).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            found = row.column("found").flatten()
            place = found.field(0).to_numpy(zero_copy_only=False)
            total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            total[place], best[place] = found.field(1).to_numpy(zero_copy_only=False), found.field(2).to_numpy(zero_copy_only=False)
            codes, sizes, links = (_unpacked(value(name)) for name in ("codes", "link_sizes", "links"))
            unit = np.repeat(np.arange(len(sizes)), sizes)
            lengths = numbers("units")
            owner = np.repeat(np.arange(len(lengths)), lengths)
            sums = [_sums(_sums(each[links], unit, len(sizes))[codes], owner, len(lengths)) for each in (best, total)]
            kept = [row.column(name).flatten() for name in ("ids", "n_a", "n_b", "n_groups", "n_links")]
            names = [field.split()[0] for field in ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), row.column("digests").flatten()], names)


def aligned_documents(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each document of the blocks: its numbers of tokens, groups and links, how many links are their B id's most frequent, ties included,
    the sum of the corpus-wide counts over its links, and the digest of its groups.

    Each block's distinct pairs meet their counts and return to the block, whose size bounds them.
    """
    each = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = each.join(links.select("pair", "n", "best"), "pair")
    found = answers.groupBy("block").agg(F.collect_list(F.struct("place", "n", F.col("best").cast("long").alias("best"))).alias("found"))
    shape = "array<struct<place:int,n:bigint,best:bigint>>"
    whole = blocks.drop("pairs", "counts").join(found, "block", "left")
    whole = whole.withColumn("found", F.coalesce("found", F.array().cast(shape)))
    return whole.mapInArrow(_document_rows, ALIGNED)


def _group_rows(stored):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=BLOCK_BYTES // 8):
            known = _kept(stored)
            out = []
            for codes in known.codes([t or "" for t in batch.column("text").to_pylist()]):
                shown = "".join(known.groups[c] for c in codes)[:-1].split(";") if len(codes) and known.valid[codes].all() else []
                sides = ([list(map(int, side.split(","))) for side in group.split("|")] for group in shown)
                out.append([{"a": a, "b": b} for a, b in sides])
            column = pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "groups"])

    return rows


def document_groups(documents: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """(doc_id, groups): each text's groups in order, with the ids of both sides; of texts without tokens an empty list."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stored = shared_tokenizers(documents.sparkSession, byte_level, pieces)
    return rows.mapInArrow(_group_rows(stored), "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    blocks = aligned_blocks(table(spark, sf_dir, "documents"))
    return aligned_documents(blocks, id_links(blocks))
