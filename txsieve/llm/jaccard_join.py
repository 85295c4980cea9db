"""Links between documents whose sets of word n-grams are alike, by rare-first prefix filtering, and their components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import cut, slices, table, text_bytes, unused
from txsieve.llm.packing import BUCKET_BITS, grams, hash_words, pack, unpack, words_of

N = 5
PERCENT = 80
KEY_BITS = 48
KEY_BYTES = 5  # of a key, its bucket gives the rest
BLOCK_TOKENS = 4 << 20
HUB_ROUNDS = 1
_LOW = np.uint64((1 << (KEY_BITS - BUCKET_BITS)) - 1)


def shingles(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; of fewer words the whole sequence is one; without words none."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    hashes = hash_words([w for text in words for w in text])
    whole = grams(hashes, n)
    ends = np.cumsum(sizes)
    out = []
    for begin, end in zip(ends - sizes, ends, strict=True):
        size = end - begin
        found = whole[begin : end - n + 1] if size >= n else grams(hashes[begin:end], int(size)) if size else hashes[:0]
        out.append(np.unique(found))
    return out


def least_overlap(left: int, right: int, percent: int = PERCENT) -> int:
    """The smallest intersection of two sets of these sizes that links them."""
    return -(-percent * (left + right) // (100 + percent))


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


_TOKENS = "bucket long, block long, keys binary, owners binary, ids array<long>, sizes array<long>, of array<int>, names binary"
_TOKEN_FIELDS = pa.schema([
    ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("of", pa.list_(pa.int32())), ("names", pa.binary()),
])


def _token_rows(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of documents: for each key bucket the keys and how many each set has, and one row that names the documents."""
        block = TaskContext.get().partitionId() << 20
        seen: dict[bytes, int] = {}
        sets: list[np.ndarray] = []
        ids: list[int | None] = []
        sizes: list[int] = []
        of: list[int] = []
        tokens = 0

        def emit() -> pa.RecordBatch:
            nonlocal block, seen, sets, ids, sizes, of, tokens
            keys = np.concatenate(sets) >> np.uint64(64 - KEY_BITS) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            bucket = (keys >> np.uint64(KEY_BITS - BUCKET_BITS)).astype(np.int16)
            order = np.argsort(bucket, kind="stable")
            keys, owner, bucket = keys[order] & _LOW, owner[order].astype("<u4"), bucket[order]
            edges = np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1))
            out = [
                {"bucket": b, "block": block, "keys": pack(keys[i:j], KEY_BYTES), "owners": pack(np.diff(owner[i:j], prepend=0), 2)}
                for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True))
                if j > i
            ]
            out.append({"bucket": -1 - block, "block": block, "ids": ids, "sizes": sizes, "of": of, "names": b"".join(seen)})
            block, seen, sets, ids, sizes, of, tokens = block + 1, {}, [], [], [], [], 0
            return pa.RecordBatch.from_pylist(out, schema=_TOKEN_FIELDS)

        for batch in slices(batches):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), shingles(batch.column("text").to_pylist(), n), strict=True):
                name = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                number = seen.setdefault(name, len(seen))
                if number == len(sets):
                    sets.append(found)
                    tokens += len(found)
                ids.append(doc_id)
                sizes.append(len(found))
                of.append(number)
                if tokens >= BLOCK_TOKENS or len(sets) >= 60_000 or len(ids) >= 500_000:
                    yield emit()
        if ids:
            yield emit()

    return rows


_SHARED = "block long, codes binary, owners binary, ids array<long>, sizes array<long>, of array<int>, names binary"


def _shared_rows(rows: pa.Table) -> pa.Table:
    """Of one bucket the keys that two sets or more have, with how many, for each block; the blocks' own rows pass through."""
    if rows.column("bucket")[0].as_py() < 0:
        empty = pa.nulls(rows.num_rows, pa.binary())
        return pa.table([rows.column("block"), empty, empty, *(rows.column(c) for c in ("ids", "sizes", "of", "names"))], names=_SHARED_NAMES)
    bucket = rows.column("bucket")[0].as_py()
    parts = [unpack(k, KEY_BYTES) for k in rows.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    count = counts[number]
    codes = (np.minimum(count, 65535).astype(np.uint64) << np.uint64(KEY_BITS)) | (np.uint64(bucket) << np.uint64(KEY_BITS - BUCKET_BITS)) | keys
    at, out_codes, out_owners = 0, [], []
    for part, owners in zip(parts, rows.column("owners").to_pylist(), strict=True):
        shared = count[at : at + len(part)] >= 2
        owner = np.cumsum(unpack(owners, 2))
        out_codes.append(codes[at : at + len(part)][shared].tobytes())
        out_owners.append(pack(np.diff(owner[shared], prepend=np.uint64(0)), 2))
        at += len(part)
    n = rows.num_rows
    return pa.table(
        [rows.column("block"), pa.array(out_codes, pa.binary()), pa.array(out_owners, pa.binary()), pa.nulls(n, pa.list_(pa.int64())),
         pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary())],
        names=_SHARED_NAMES,
    )


_SHARED_NAMES = ["block", "codes", "owners", "ids", "sizes", "of", "names"]
_SETS = "doc_id long, name binary, size long, codes binary"
_SET_FIELDS = pa.schema([("doc_id", pa.int64()), ("name", pa.binary()), ("size", pa.int64()), ("codes", pa.binary())])


def _set_rows(percent: int):
    def sets(rows: pa.Table) -> pa.Table:
        """A block's documents, and of the sets that can have a partner the shared n-grams, the rarest first."""
        heads = rows.filter(pa.compute.is_valid(rows.column("names")))
        ids, sizes, of = (heads.column(c)[0].as_py() for c in ("ids", "sizes", "of"))
        joined = heads.column("names")[0].as_py()
        names = [joined[i : i + 16] for i in range(0, len(joined), 16)]
        size_of = dict(zip(of, sizes, strict=True))
        bodies = rows.filter(pa.compute.is_valid(rows.column("codes")))
        codes = [np.frombuffer(c, np.uint64) for c in bodies.column("codes").to_pylist()]
        owners = [np.cumsum(unpack(o, 2)) for o in bodies.column("owners").to_pylist()]
        codes, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (codes, owners))
        order = np.lexsort((codes, owner))
        codes, edges = codes[order], np.searchsorted(owner[order], np.arange(len(names) + 1, dtype=np.uint64))
        named, counted, kept = [], [], []
        for i, name in enumerate(names):
            own = codes[edges[i] : edges[i + 1]]
            if prefix_length(size_of[i], percent) > size_of[i] - len(own) and len(own):
                named.append(name)
                counted.append(size_of[i])
                kept.append(own.tobytes())
        docs = pa.table([pa.array(ids, pa.int64()), pa.array([names[i] for i in of], pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(len(ids), pa.binary())], schema=_SET_FIELDS)
        found = pa.table([pa.nulls(len(named), pa.int64()), pa.array(named, pa.binary()), pa.array(counted, pa.int64()), pa.array(kept, pa.binary())], schema=_SET_FIELDS)
        return pa.concat_tables([docs, found])

    return sets


_PREFIX = "name binary, size long, code long, place long, alone long"


def _prefix_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of each set's prefix, with their places in its rare-first order; those no other set has come before all of these."""
        for batch in batches:
            names, sizes, codes, places, alones = [], [], [], [], []
            for name, size, own in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "codes")), strict=True):
                alone = size - len(own) // 8
                prefix = np.frombuffer(own, np.int64)[: max(0, prefix_length(size, percent) - alone)]
                names += [name] * len(prefix)
                sizes += [size] * len(prefix)
                alones += [alone] * len(prefix)
                codes.append(prefix)
                places.append(alone + np.arange(len(prefix)))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.concatenate([none, *codes])),
                    pa.array(np.concatenate([none, *places])),
                    pa.array(alones, pa.int64()),
                ],
                ["name", "size", "code", "place", "alone"],
            )

    return rows


def suffix_passes(left: np.ndarray, right: np.ndarray, least: int, depth: int = 2) -> bool:
    """Whether two ordered lists can share ``least`` codes: halves around a pivot bound what their parts can share, ``depth`` times."""
    most = min(len(left), len(right))
    if most < least or not depth or most == 0:
        return most >= least
    pivot = right[len(right) // 2]
    i, j = np.searchsorted(left, pivot), len(right) // 2
    return min(i, j) + min(len(left) - i, len(right) - j) >= least and (
        depth == 1
        or suffix_passes(left[:i], right[:j], least - min(len(left) - i, len(right) - j), depth - 1)
        and suffix_passes(left[i:], right[j:], least - min(i, j), depth - 1)
    )


def _links(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that are links: the suffix filter first, then the whole intersection, which the shared n-grams hold."""
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_size", "b_size", "a_codes", "b_codes")), strict=True):
                x, y, least = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least_overlap(m, n, percent)
                if not suffix_passes(x, y, least):
                    keep.append(False)
                    continue
                at = np.searchsorted(x, y)
                common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                keep.append(100 * common >= percent * (m + n - common))
            found = batch.select(["a", "b"])
            yield found.filter(pa.array(keep, pa.bool_()))

    return rows


def _can_link(percent: int):
    """Length and positional filters of a pair of prefix rows x and y with a common code.

    The positional filter counts no earlier common codes. It is right for the first common code of a pair, at which every link therefore passes.
    """
    least = F.ceil(percent * (F.col("x.size") + F.col("y.size")) / (100 + percent))
    lengths = 100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")
    return lengths & (F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= least)


#: Partners' sizes are told apart by at least this many classes for each doubling of the size.
SIZE_CLASSES = 64


def _width(size: Column) -> Column:
    """How many sizes make a class for a set of this size: a power of two, 1 for small sets."""
    bits = F.length(F.bin(size)) - 1 - (SIZE_CLASSES.bit_length() - 1)
    return F.pow(F.lit(2), F.greatest(F.lit(0), bits)).cast("long")


def _probes(member: DataFrame, percent: int) -> DataFrame:
    """Each row of a list for each class of sizes that its length and place in the set's order leave for a partner, with the class's ``width`` and ``kind``.

    A partner of size t shares at least percent * (size + t) / (100 + percent) n-grams, of which none come before this place.
    """
    size, left = F.col("size"), F.col("size") - F.col("place")
    least = F.ceil(percent * size / 100).cast("long")
    most = F.least(F.floor(100 * size / percent), F.floor(left * (100 + percent) / percent) - size).cast("long")
    ranged = member.withColumn("width", _width(size)).withColumn("least", least).withColumn("most", most).filter("most >= least")
    kinds = F.sequence(F.floor(F.col("least") / F.col("width")), F.floor(F.col("most") / F.col("width")))
    return ranged.withColumn("kind", F.explode(kinds)).drop("least", "most")


def _homes(member: DataFrame) -> DataFrame:
    """Each row of a list under its own size's class, for every width that a partner may have."""
    own = _width(F.col("size"))
    widths = F.array_distinct(F.array(F.greatest(F.lit(1).cast("long"), F.floor(own / 2).cast("long")), own, 2 * own))
    spread = member.withColumn("width", F.explode(widths))
    return spread.withColumn("kind", F.floor(F.col("size") / F.col("width")))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): the least node that links reach.

    Large-star and small-star steps by turns: neighbours move to the least neighbour, until every node hangs on its least one. Each
    step aggregates minima before it moves them; the edges are written after each round, and a round compares its sum with the last.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "star-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            return pairs.unionByName(pairs.select(F.col("comp").alias("node"), "comp").distinct())
        state = found


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of names that are links, each compared once."""
    left = sets.select(F.col("name").alias("a"), F.col("size").alias("a_size"), F.col("codes").alias("a_codes"))
    right = sets.select(F.col("name").alias("b"), F.col("size").alias("b_size"), F.col("codes").alias("b_codes"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_links(percent), "a binary, b binary")


def _hub_pairs(member: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each set b the hub a, of another component, that it meets in most lists.

    A list's hub is the set in it with the smallest share of n-grams of its own: the least changed of a group of copies. So there are no more pairs
    than sets, however long a list is.
    """
    own = F.struct(F.col("alone") / F.col("size"), "name")
    hubs = member.groupBy("code").agg(F.min_by(F.struct("name", "size", "place", "comp"), own).alias("x"))
    met = member.alias("y").join(cut(hubs, "join-hubs"), "code").filter((F.col("x.comp") != F.col("y.comp")) & _can_link(percent))
    count = met.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.count("*").alias("n"))
    return count.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")


def _open_lists(member: DataFrame) -> DataFrame:
    """The members of the lists that still have sets of different components, with the list's largest component."""
    count = member.groupBy("code", "comp").agg(F.count("*").alias("n"))
    main = count.groupBy("code").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return cut(member.join(cut(main, "join-main"), "code"), "join-open")


def class_links(sets: DataFrame, percent: int, rounds: int = HUB_ROUNDS) -> DataFrame:
    """Links (a, b) between distinct sets, enough to join all that any link joins, and no pair that isn't one.

    Sets meet where their prefixes share an n-gram. In the first rounds each set is compared with one hub, which joins large groups of near copies
    by as many pairs as they have members. Then all pairs of one list that are still in different components, and pass the length and
    positional filters, are compared. These filters are part of the join's key, by classes of sizes, so that pairs which can't pass
    aren't formed, however long a list is. Pairs within a component need no comparison, and members of a list's largest component
    are not paired with each other.
    """
    prefix = cut(sets.mapInArrow(_prefix_rows(percent), _PREFIX), "join-prefix")
    lists = cut(prefix.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select("code"), "join-lists")
    member = cut(prefix.join(lists, "code").withColumn("comp", F.col("name")), "join-members")
    links = None
    for _ in range(rounds):
        found = _verified(_hub_pairs(member, percent), sets, percent)
        links = cut(links.unionByName(found) if links is not None else found, "join-links")
        groups = components(links).withColumnRenamed("node", "name").withColumnRenamed("comp", "now")
        member = member.join(groups, "name", "left").withColumn("comp", F.coalesce("now", "name")).drop("now", "main")
        member = _open_lists(cut(member, "join-members"))
    probes = _probes(member.filter("comp <> main"), percent).alias("x")
    pairs = (
        probes.join(_homes(member).alias("y"), ["code", "width", "kind"])
        .filter(F.expr("x.comp <> y.comp AND (y.comp = y.main OR x.name < y.name)") & _can_link(percent))
        .select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b"))
        .distinct()
    )
    return links.unionByName(_verified(cut(pairs, "join-pairs"), sets, percent))


def near_duplicates(documents: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Equal sets are one class, named by 128 bits of a hash of its n-grams; only classes are compared. Each task packs its sets' keys by
    bucket; buckets count each n-gram over all documents and give back those that two sets or more have. n-grams that only one set has come first in the
    rare-first order, so a set whose prefix has none but those can't have a partner and is done. Intersections are exact, as
    they lie in the shared n-grams. A text without words has n_shingles 0 and is its own component, whatever other empty texts there are. Rows
    with null doc_id take part; a component of such rows alone has a null id. Repeated rows of a doc_id each get their row.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    tokens = texts.mapInArrow(_token_rows(n), _TOKENS)
    shared = tokens.groupBy("bucket").applyInArrow(_shared_rows, _SHARED)
    found = cut(shared.groupBy("block").applyInArrow(_set_rows(percent), _SETS), "join-sets")
    docs = found.filter("codes IS NULL").select("doc_id", "name", "size")
    sets = found.filter("codes IS NOT NULL").groupBy("name").agg(F.first("size").alias("size"), F.first("codes").alias("codes"))
    groups = components(class_links(cut(sets, "join-classes"), percent))
    classes = docs.filter("size > 0").groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    joined = classes.join(groups.withColumnRenamed("node", "name"), "name", "left")
    joined = cut(joined.filter("n > 1 OR comp IS NOT NULL").withColumn("comp", F.coalesce("comp", "name")), "join-comps")
    least = cut(joined.groupBy("comp").agg(F.min("least").alias("component_id")), "join-least")
    label = cut(joined.join(least, "comp").select("name", "component_id"), "join-labels")
    return docs.join(label, "name", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(documents: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, but of each component only one row: that of the least doc_id, null last.

    Rows are told apart by numbers of their own, written with them, so that rows of one doc_id or of none stay or go by their own texts. Rows
    without words are components of their own and all stay.
    """
    own = unused("_row", documents.columns)
    rows = cut(documents.select("*", F.monotonically_increasing_id().alias(own)), "join-rows")
    found = near_duplicates(rows.select(F.col(own).alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias(own), "component_id")
    found = cut(found, "join-found")
    shared = cut(found.filter(F.col(own) != F.col("component_id")).select("component_id").distinct(), "join-shared")
    members = cut(found.join(shared, "component_id"), "join-members")
    id_ = F.col("doc_id").cast("long")
    rank = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64("text").alias("hash"), F.col(own))
    ranked = rows.select(own, rank.alias("rank")).join(members, own)
    kept = cut(ranked.groupBy("component_id").agg(F.min("rank").alias("kept")).select("component_id", F.col(f"kept.{own}").alias("kept")), "join-kept")
    drop = cut(members.join(kept, "component_id").filter(F.col(own) != F.col("kept")).select(own), "join-drop")
    return rows.join(drop, own, "left_anti").select(*documents.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
