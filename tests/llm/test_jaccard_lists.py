"""The join of long lists: the filters in its key lose no pair and form few."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txsieve.llm import jaccard_join


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    """Every pair compared, by sets of word tuples."""
    sets = [(i, plain_shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return sorted((i, len(s), min(least[find(k)])) for k, (i, s) in enumerate(sets))


def run(spark, rows):
    return jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_of_all_likenesses_equal_comparing_every_pair(spark, seed):
    """Variants of a few texts with words changed, cut and added, so that likenesses lie around the threshold at many sizes."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(3))
    texts = []
    for size in (5, 7, 9, 12, 30, 70, 150, 400):
        base = [word() for _ in range(size)]
        for _ in range(14):
            own = list(base)
            for _ in range(draw.randrange(0, 2 + size // 25)):
                at = draw.randrange(len(own))
                own[at : at + draw.randrange(0, 2)] = [word() for _ in range(draw.randrange(0, 3))]
            texts.append(" ".join(own[draw.randrange(0, 2) * (size // 12) :] + [word() for _ in range(draw.randrange(0, 1 + size // 8))]))
    rows = list(enumerate(texts))
    assert sorted(map(tuple, run(spark, rows).collect())) == plain_components(rows)


def test_texts_with_one_word_of_their_own_form_no_pairs(spark):
    """Lists of thousands of sets without a link: the work grows with them, not with their pairs."""
    took = {}
    for size in (1_000, 2_000, 40_000):
        rows = [(i, f"the quick brown fox jumps over a dog own{i}") for i in range(size)]
        start = time.perf_counter()
        found = run(spark, rows).agg(F.count("*"), F.count_if(F.col("doc_id") == F.col("component_id"))).first()
        took[size] = time.perf_counter() - start
        assert tuple(found) == (size, size)
    assert took[40_000] < 4 * took[2_000] + 10


def test_the_key_holds_every_pair_that_passes_the_filters(spark):
    draw = random.Random(3)
    rows = []
    for k in range(700):
        size = draw.choice([1, 2, 5, 6, 9, 63, 64, 65, 127, 128, 129, 255, 256, 300, 511, 513, 1000])
        size = max(1, size + draw.randrange(-2, 3))
        rows.append((f"n{k:04}".encode(), size, draw.randrange(3), draw.randrange(0, max(1, size // 5 + 1)), 0, f"n{k:04}".encode(), b"main"))
    member = spark.createDataFrame(rows, "name binary, size long, code long, place long, alone long, comp binary, main binary").cache()
    wanted = member.alias("x").join(member.alias("y"), "code").filter(jaccard_join._can_link(80)).select("x.name", F.col("y.name").alias("other"))
    keyed = jaccard_join._probes(member, 80).alias("x").join(jaccard_join._homes(member).alias("y"), ["code", "width", "kind"])
    got = keyed.filter(jaccard_join._can_link(80)).select("x.name", F.col("y.name").alias("other"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert keyed.count() < member.alias("x").join(member.alias("y"), "code").count() / 3
