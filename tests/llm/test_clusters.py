"""Centroid clusters against plain Python whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpus import SF_DIR
from gridfuse.llm import clusters as C


def brute(rows, number, rounds, size):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) of (vec_id, embedding)."""
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != size or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v]))

    def key(entry):
        digest = hashlib.sha256(f"2:{entry[0]}".encode()).hexdigest()
        return (entry[0] is None, digest if entry[0] is not None else "", entry[1])

    centres = [list(v) for _, v in sorted(kept, key=key)[:number]]

    def assign():
        found = []
        for _, v in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            least = min(apart)
            found.append((apart.index(least), least))
        return found

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (at, _) in zip(kept, found) if at == c]
            if own:
                centres[c] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    inertia = {c: sum(d for at, d in found if at == c) for c in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [
        (vec_id, c, d, inertia[c], sum(inertia.values()), sha[c])
        for (vec_id, _), (c, d) in zip(kept, found)
    ]


def table(spark, rows):
    data = [(i, v, 1, None, 7) for i, v in rows]
    schema = "vec_id long, embedding array<float>, label int, cluster string, x int"
    return spark.createDataFrame(data, schema).repartition(3)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def vectors(seed, rows, size):
    rnd = random.Random(seed)
    return [(i, [rnd.uniform(-1, 1) + i % 5 for _ in range(size)]) for i in range(rows)]


@pytest.mark.parametrize("number, rounds, size", [(7, 3, 4), (40, 2, 2), (3, 0, 64)])
def test_clusters_equal_plain_python(spark, number, rounds, size):
    rows = vectors(number, 150, size)
    found = C.clusters(table(spark, rows), number, rounds, size)
    assert ordered(found.collect()) == ordered(brute(rows, number, rounds, size))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [-0.25, 1.0]), (None, [0.1, -0.1]),
        (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]),
        (9, [1.0, 2.0, 3.0]), (10, [-0.001, 0.0]), (11, [300.0, -300.0]), (None, [0.1, -0.1]),
    ]
    for number in (1, 3, 40):
        found = C.clusters(table(spark, rows), number, 4, 2).collect()
        assert ordered(found) == ordered(brute(rows, number, 4, 2)) and len(found) == 8


def test_no_vectors(spark):
    for rows in ([], [(1, None)]):
        found = C.clusters(table(spark, rows))
        assert found.count() == 0 and found.columns == [c.split()[0] for c in C.RESULT.split(", ")]


def test_equal_vectors_make_no_pivot_pair(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)]
    found = C.clusters(table(spark, rows), 40, 5, 2).collect()
    assert {(r.cluster, r.distance) for r in found} == {(0, 0)} and len(found) == 50


def test_too_large_components_stop_the_job(spark):
    with pytest.raises(Exception, match="too large"):
        C.clusters(table(spark, [(1, [1e30, 0.0])]), 40, 5, 2).collect()


def test_bounds_are_never_above_the_distance():
    rng = np.random.default_rng(3)
    for scale in (1, 300, C.LIMIT - 1):
        x = rng.integers(-scale, scale, size=(400, 64), endpoint=True)
        x[200:] = x[0] + rng.integers(-1, 2, size=(200, 64))
        pivots = C.Pivots.spread(x[:20], C.PIVOTS)
        found = pivots.bounds(pivots.distances(x), pivots.distances(x[:40]))
        exact = np.stack([C.squared(x, c) for c in x[:40]], axis=1)
        assert (found <= exact).all()


def test_bounds_save_distances():
    """Vectors in tight groups are compared with few centroids."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, size=(40, 64))
    x = np.repeat(centres, 50, axis=0) + rng.integers(-20, 20, size=(2000, 64))
    pivots = C.Pivots.spread(centres, C.PIVOTS)
    best, least, tried = C.nearest(x, pivots.distances(x), pivots, centres)
    assert (best == np.repeat(np.arange(40), 50)).all() and tried < 3 * len(x)
    assert (least == C.squared(x, centres[best])).all()


def test_query_over_the_given_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    found = C.clusters(rows).collect()
    given = [(r.vec_id, r.embedding) for r in rows.collect()]
    assert ordered(found) == ordered(brute(given, 40, 5, 64))
