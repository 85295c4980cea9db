"""Clustering by cells against plain clustering of the same integers."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from txsieve.llm import vector_clusters
from txsieve.llm.vector_clusters import CLUSTERS, DIMENSIONS, ROUNDS


def as_table(spark, rows):
    """With columns that have the names of results and of inner columns."""
    schema = "vec_id long, embedding array<float>, cluster string, page string, distance int, vector int"
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], schema)


def plain(rows, clusters=CLUSTERS, rounds=ROUNDS):
    """(vec_id, cluster, distance, cluster's sum, sum, centroid's hash) by comparing everything."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == DIMENSIONS and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(64 * float(np.float32(x))))) for x in v]))
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [list(v) for _, v in named[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            if far:
                out.append((i, far.index(min(far)), min(far), v))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for _, c, _, v in assign():
            members[c].append(v)
        for c, vectors in members.items():
            centroids[c] = [sum(x) // len(vectors) for x in zip(*vectors, strict=True)]
    found = assign()
    sums = Counter()
    for _, c, d, _ in found:
        sums[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return Counter((i, c, d, sums[c], sum(sums.values()), name(c)) for i, c, d, _ in found)


def clustered(spark, rows, parts=3):
    vectors = vector_clusters.quantised(as_table(spark, rows).repartition(parts))
    return vector_clusters.with_inertia(vector_clusters.cluster(vectors, vector_clusters.first_centroids(vectors)))


def groups(n, seed, spread=0.05):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(DIMENSIONS)] for _ in range(9)]
    return [[x + draw.gauss(0, spread) for x in draw.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_equals_plain_clustering(spark, spread):
    vectors = groups(600, 4, spread)
    rows = list(enumerate(vectors))
    rows += [(5, vectors[9]), (5, vectors[5]), (None, vectors[7]), (None, vectors[7]), (900, None), (901, []), (902, vectors[0][:-1]), (903, [*vectors[0], 0.0])]
    rows += [(904, [None, *vectors[0][1:]]), (905, [math.nan, *vectors[0][1:]]), (906, [math.inf, *vectors[0][1:]]), (907, [1e30, -1e30, *vectors[0][2:]])]
    assert Counter(map(tuple, clustered(spark, rows).collect())) == plain(rows)


def test_ties_and_copies(spark):
    """Vectors on a grid, so that distances tie; more than half of the rows are one vector, so that centroids are equal and clusters empty."""
    draw = random.Random(9)
    rows = [(i, [float(draw.randrange(2)) for _ in range(4)] + [0.0] * (DIMENSIONS - 4)) for i in range(60)]
    rows += [(i, [0.5] * DIMENSIONS) for i in range(60, 160)]
    assert Counter(map(tuple, clustered(spark, rows).collect())) == plain(rows)


def test_few_and_no_vectors(spark):
    rows = list(enumerate(groups(5, 1)))
    assert Counter(map(tuple, clustered(spark, rows).collect())) == plain(rows)
    assert clustered(spark, []).collect() == []
    assert clustered(spark, [(1, None), (2, [1.0])]).collect() == []
    # Vectors without an id are no centroids.
    assert clustered(spark, [(None, [0.0] * DIMENSIONS)]).collect() == []


def test_later_rounds_read_few_vectors(spark):
    """In clear groups cells decide nearly all, and pages without an open or moved vector aren't read."""
    vectors = vector_clusters.quantised(as_table(spark, list(enumerate(sorted(groups(6000, 3))))).coalesce(2))
    found = vector_clusters.cluster(vectors, vector_clusters.first_centroids(vectors, 4), rounds=4)
    assert found.fetched[-1][0] < found.fetched[-1][1] / 2
    assert found.assigned.count() == 6000


def test_intervals_hold_every_distance():
    draw = np.random.default_rng(3)
    vectors = draw.integers(-300, 300, (500, DIMENSIONS - 1))
    vectors[::7] *= 40
    centroids = vectors[draw.integers(0, 500, 20)] + draw.integers(-3, 3, (20, DIMENSIONS - 1))
    marks = np.sort(np.concatenate([np.tile(vectors.min(axis=0), (1, 1)), draw.integers(-300, 300, (15, DIMENSIONS - 1)).clip(vectors.min(axis=0)),
                                    np.tile(vectors.max(axis=0) + 1, (1, 1))]), axis=0).T
    tables = vector_clusters.lookup_tables(centroids, marks)
    cells = vector_clusters.cells_of(vectors, marks)
    total = sum(tables[b][cells[:, b]] for b in range(len(tables)))
    exact = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (total[:, :20] <= exact).all()
    assert (exact <= total[:, 20:]).all()
    possible = vector_clusters.candidates(cells, tables)
    assert possible[np.arange(500), exact.argmin(axis=1)].all()
    assert possible.mean() < 0.9
    assert (vector_clusters.nearest(vectors, centroids, possible) == exact.argmin(axis=1)).all()
