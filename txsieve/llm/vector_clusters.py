"""Centroid clustering of integer vectors by a vector-approximation file: cells of a few bits first, whole vectors only where they can't decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import cut, table

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Bits of a cell; two cells make a byte, so that one table row a byte gives two dimensions' distances.
CELL_BITS = 4
CELLS = 1 << CELL_BITS
PAGE_VECTORS = 64
#: Components are held within this, so that a squared distance of ``DIMENSIONS`` components fits 64 bits.
LARGEST = 1 << 27
_NONE = 255


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the vectors of that many components, none of them null or not finite, as ``floor(scale * x)`` of each."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale).cast("long"))).cast("int")
    embedding = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    kept = rows.filter((F.size("embedding") == dimensions) & F.forall("embedding", number))
    # Larger numbers are cut off before they are made whole.
    held = F.transform("embedding", lambda x: whole(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x))))
    return kept.select("vec_id", held.alias("vector"))


def first_centroids(quantised_rows: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order; of rows with one id the smaller vector first. At most ``clusters`` rows are collected."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    named = quantised_rows.filter("vec_id IS NOT NULL").select(key.alias("key"), "vector")
    rows = named.orderBy("key", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def _spread_rows(dimensions: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        least, most = np.full(dimensions, LARGEST, np.int64), np.full(dimensions, -LARGEST, np.int64)
        for batch in batches:
            values = _matrix(batch.column("vector"), dimensions)
            if len(values):
                count += len(values)
                sums, squares = sums + values.sum(axis=0), squares + (values.astype(np.float64) ** 2).sum(axis=0)
                least, most = np.minimum(least, values.min(axis=0)), np.maximum(most, values.max(axis=0))
        if count:
            found = [np.arange(dimensions), np.full(dimensions, count), sums, squares, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["dimension", "n", "total", "squares", "least", "most"])

    return rows


def cell_marks(quantised_rows: DataFrame, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Where each dimension's cells begin, and the end of the last: by the mean and deviation of all vectors, so that cells are about equally full.

    Any marks give right clusters. Tasks send a row a dimension.
    """
    spread = quantised_rows.select("vector").mapInArrow(
        _spread_rows(dimensions), "dimension long, n long, total double, squares double, least long, most long"
    )
    rows = spread.groupBy("dimension").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    marks = np.zeros((dimensions, CELLS + 1), np.int64)
    at = np.array([NormalDist().inv_cdf(i / CELLS) for i in range(1, CELLS)])
    for row in rows.collect():
        mean = row["total"] / row["n"]
        deviation = max(row["squares"] / row["n"] - mean * mean, 0.0) ** 0.5
        inner = np.clip(np.rint(mean + deviation * at), row["least"], row["most"] + 1).astype(np.int64)
        marks[row["dimension"]] = [row["least"], *inner, row["most"] + 1]
    return marks


def cells_of(vectors: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The cells of each vector, two dimensions a byte."""
    cells = np.stack([np.searchsorted(marks[d, 1:-1], vectors[:, d], side="right") for d in range(len(marks))], axis=1).astype(np.uint8)
    if cells.shape[1] % 2:
        cells = np.concatenate([cells, np.zeros((len(cells), 1), np.uint8)], axis=1)
    return cells[:, ::2] << CELL_BITS | cells[:, 1::2]


def lookup_tables(centroids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each byte of cells and each of its values: the least squared distance that its two dimensions can have to every centroid, then the largest."""
    low, high = marks[:, :-1], np.maximum(marks[:, 1:] - 1, marks[:, :-1])
    to_low, to_high = centroids[:, :, None] - low[None], centroids[:, :, None] - high[None]
    largest = np.maximum(to_low**2, to_high**2)
    least = np.where((to_low >= 0) & (to_high <= 0), 0, np.minimum(to_low**2, to_high**2))
    each = np.concatenate([least, largest]).transpose(1, 2, 0)
    if len(each) % 2:
        each = np.concatenate([each, np.zeros_like(each[:1])])
    return (each[::2, :, None, :] + each[1::2, None, :, :]).reshape(len(each) // 2, CELLS * CELLS, -1)


def candidates(cells: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Which centroids each vector may be nearest to: those whose interval of distances begins no later than the first one ends."""
    total = np.zeros((len(cells), tables.shape[2]), np.int64)
    for byte in range(len(tables)):
        total += tables[byte][cells[:, byte]]
    clusters = tables.shape[2] // 2
    return total[:, :clusters] <= total[:, clusters:].min(axis=1, keepdims=True)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The squared distance of each vector to the centroid beside it."""
    return ((vectors - centroids) ** 2).sum(axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """The nearest of the possible centroids of each vector, the smaller number of equally near ones."""
    row, centroid = np.nonzero(possible)
    distance = np.full(possible.shape, np.iinfo(np.int64).max)
    distance[row, centroid] = squared_distances(vectors[row], centroids[centroid])
    return distance.argmin(axis=1)


def _page_rows(marks: np.ndarray, dimensions: int):
    names = ["page", "ids", "cells", "values"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, PAGE_VECTORS):
                part = batch.slice(start, PAGE_VECTORS)
                values = _matrix(part.column("vector"), dimensions)
                row = [page, part.column("vec_id").to_pylist(), cells_of(values, marks).tobytes(), values.astype("<i4").tobytes()]
                types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)
                page += 1

    return rows


def approximation_file(quantised_rows: DataFrame, marks: np.ndarray) -> DataFrame:
    """The vectors as written pages: (page, ids, cells, values). A scan of the cells alone reads an eighth of what the values take."""
    return cut(quantised_rows.mapInArrow(_page_rows(marks, len(marks)), "page long, ids array<long>, cells binary, values binary"), "vector-pages")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pages one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


_MOVED_TYPE = "array<struct<cluster:int,n:bigint,sums:array<bigint>>>"
_ROUND = f"page long, cells binary, clusters binary, moved {_MOVED_TYPE}"
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


class _Round:
    """One round's centroids and tables, as tasks get them."""

    def __init__(self, centroids: np.ndarray, marks: np.ndarray):
        self.centroids, self.tables = centroids, lookup_tables(centroids, marks)

    def page(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, len(self.tables))
        possible = candidates(cells, self.tables)
        return possible, possible.sum(axis=1) > 1

    def values(self, row: dict) -> np.ndarray:
        return np.frombuffer(row["values"], "<i4").reshape(-1, self.centroids.shape[1]).astype(np.int64)

    def assign(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cluster, and the page's vectors: those that cells don't decide are compared whole."""
        possible, open_ones = self.page(row)
        values = self.values(row)
        found = possible.argmax(axis=1)
        found[open_ones] = nearest(values[open_ones], self.centroids, possible[open_ones])
        return found, values


def _moved(before: np.ndarray, after: np.ndarray, values: np.ndarray) -> list[dict]:
    """What the vectors that changed their cluster take from the old one's sums and bring to the new one's."""
    out = []
    changed = before != after
    for clusters, sign in ((before, -1), (after, 1)):
        for cluster in np.unique(clusters[changed]).tolist():
            if cluster != _NONE:
                some = values[changed & (clusters == cluster)]
                out.append({"cluster": cluster, "n": sign * len(some), "sums": (sign * some.sum(axis=0)).tolist()})
    return out


def _round_row(row: dict, clusters: np.ndarray, moved: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([row["page"]]), pa.array([row["cells"]], pa.binary()), pa.array([clusters.astype(np.uint8).tobytes()], pa.binary()), pa.array([moved], _MOVED)]
    return pa.RecordBatch.from_arrays(columns, ["page", "cells", "clusters", "moved"])


def _whole_rows(current: _Round):
    """Pages with their vectors and, from the second round on, their clusters so far, to the pages' new clusters."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            found, values = current.assign(row)
            before = np.frombuffer(row["clusters"], np.uint8) if row.get("clusters") else np.full(len(found), _NONE, np.uint8)
            yield _round_row(row, found, _moved(before.astype(np.int64), found, values))

    return rows


def _cell_rows(current: _Round):
    """Pages without their vectors, to which of them need these: where cells leave a choice, or a vector has another cluster than before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fetch = []
            for row in batch.select(["cells", "clusters"]).to_pylist():
                possible, open_ones = current.page(row)
                fetch.append(bool(open_ones.any() or (possible.argmax(axis=1) != np.frombuffer(row["clusters"], np.uint8)).any()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page", "cells", "clusters")), pa.array(fetch, pa.bool_())], ["page", "cells", "clusters", "fetch"])

    return rows


def _last_rows(current: _Round):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            found, values = current.assign(row)
            distance = squared_distances(values, current.centroids[found])
            columns = [pa.array(row["ids"], pa.int64()), pa.array(found.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return rows


@dataclass
class Clustering:
    """(vec_id, cluster, distance) of every vector, the centroids they were assigned to, and of each round the pages whose vectors were read and all pages."""

    assigned: DataFrame
    centroids: np.ndarray
    fetched: list[tuple[int, int]]


def _new_centroids(centroids: np.ndarray, counts: list[int], sums: list[list[int]]) -> np.ndarray:
    rows = [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, centroids.tolist(), strict=True)]
    return np.array(rows, np.int64).reshape(centroids.shape)


def cluster(quantised_rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> Clustering:
    """Assigns vectors to their nearest centroids and moves these to their vectors' floored mean, ``rounds`` times, then assigns once more.

    Vectors are packed into pages of cells and values once. The first round and the last read all values, for the sums and the distances; the
    rounds between read the cells and, joined by page, only the values of pages with a vector that cells leave open or that moved, whose
    sums change by what moved. Each round is written. The driver gets a centroid's sums and counts, never vectors.
    Clusters are numbered by a byte, so there are at most 255 of them. Without centroids there are no vectors, and nothing is assigned.
    """
    if len(centroids) > _NONE:
        raise ValueError(f"{len(centroids)} centroids, at most {_NONE} are possible")
    spark = quantised_rows.sparkSession
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, [])
    marks = cell_marks(quantised_rows, centroids.shape[1])
    pages = approximation_file(quantised_rows, marks)
    counts, sums = [0] * len(centroids), [[0] * centroids.shape[1] for _ in centroids]
    current, fetched = None, []
    for _ in range(rounds):
        now = _Round(centroids, marks)
        if current is None:
            current = cut(pages.select("page", "cells", "values").mapInArrow(_whole_rows(now), _ROUND), "cluster-round")
        else:
            tested = cut(
                current.select("page", "cells", "clusters").mapInArrow(_cell_rows(now), "page long, cells binary, clusters binary, fetch boolean"),
                "cluster-cells",
            )
            wanted = tested.filter("fetch").join(pages.select("page", "values"), "page").mapInArrow(_whole_rows(now), _ROUND)
            rest = tested.filter("NOT fetch").select("page", "cells", "clusters", F.array().cast(_MOVED_TYPE).alias("moved"))
            current = cut(wanted.unionByName(rest), "cluster-round")
            found = tested.agg(F.count_if("fetch"), F.count("*")).first()
            fetched.append((found[0], found[1]))
        for row in _moved_sums(current):
            counts[row["cluster"]] += int(row["n"])
            sums[row["cluster"]][row["dimension"]] += int(row["total"]) if row["dimension"] >= 0 else 0
        centroids = _new_centroids(centroids, counts, sums)
    last = pages.select("ids", "cells", "values").mapInArrow(_last_rows(_Round(centroids, marks)), "vec_id long, cluster int, distance long")
    return Clustering(last, centroids, fetched)


def _moved_sums(current: DataFrame) -> list:
    """What each cluster's count and each of its sums change by in a round: a row a cluster and dimension, the count under dimension -1."""
    each = current.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", "m.sums")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    totals = each.select("cluster", F.posexplode("sums").alias("dimension", "x")).groupBy("cluster", "dimension").agg(F.lit(0).alias("n"), wide("x").alias("total"))
    numbers = each.groupBy("cluster").agg(wide("n").alias("n")).select("cluster", F.lit(-1).alias("dimension"), "n", F.lit(0).alias("total"))
    return totals.unionByName(numbers).collect()


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row of sums a cluster is broadcast, at most 255."""
    spark = found.assigned.sparkSession
    assigned = cut(found.assigned, "clusters")
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    names = [digest(c) for c in found.centroids.tolist()]
    rows = [(k, sums.get(k, 0), sum(sums.values()), name) for k, name in enumerate(names)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clusters(spark, sf_dir: str) -> DataFrame:
    vectors = cut(quantised(table(spark, sf_dir, "embeddings")), "quantised")
    return with_inertia(cluster(vectors, first_centroids(vectors)))


def _round_sql(number: int) -> str:
    """The assignment to the centroids ``c{number}`` and the centroids that follow from it."""
    return f"""
), d{number} AS (
  SELECT k.rid, c.c, list_sum([(k.v[i] - c.v[i]) * (k.v[i] - c.v[i]) FOR i IN range(1, {DIMENSIONS + 1})])::BIGINT AS distance
  FROM kept k, c{number} c
), a{number} AS (
  SELECT rid, c, distance FROM d{number} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1
), s{number} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT a.c, unnest(range(1, {DIMENSIONS + 1})) AS i, unnest(k.v) AS x FROM a{number} a JOIN kept k ON k.rid = a.rid) u GROUP BY c, i
), m{number} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{number} GROUP BY c
), c{number + 1} AS (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{number} o LEFT JOIN m{number} m ON m.c = o.c"""


OP11_SQL = (
    f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMENSIONS}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS}"""
    + "".join(map(_round_sql, range(ROUNDS + 1)))
    + f"""
)
SELECT k.vec_id, a.c::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k ON k.rid = a.rid JOIN c{ROUNDS} c ON c.c = a.c
"""
)
