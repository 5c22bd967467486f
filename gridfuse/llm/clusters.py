"""Centroid clustering of whole-number vectors, with Ptolemaic pivot bounds.

For a vector x, a centroid c and two pivots p, q, Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q).

A few pivots are chosen once and stay.  The distances of every vector to them are
computed once, in the pass that writes the vectors, and serve all rounds; those of the
centroids are 40 short rows per round.  A round starts from the centroid with the least
bound and computes exactly only the distances whose bound, rounded down, does not exceed
the best one so far.  Distances are whole numbers, so results depend neither on the order
of the rows nor on the bounds.

What moves per round is one row per cluster and task (count and sums); the driver holds
the centroids and the pivots, whose number is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.llm.common import Workspace

SIZE, CLUSTERS, ROUNDS, PIVOTS, SCALE = 64, 40, 5, 6, 256
#: Below this every squared distance of 64 components fits a long.
LIMIT = 2**27
_ROWS_AT_ONCE = 4096
#: What floating point may add to a difference of products, and to a squared bound.
_SLACK, _SHRINK = 2.0**-50, 1 - 2.0**-45
RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
    "centroid_sha256 string"
)


def whole_vectors(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, x): the vectors with exactly ``size`` finite components, scaled and floored."""
    finite = "forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('inf'))"
    kept = rows.where(F.size("embedding") == size).where(F.expr(finite))
    cells = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE))
    large = F.exists("cells", lambda c: F.abs(c) >= LIMIT)
    stop = F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")
    cells = kept.select(F.col("vec_id").cast("long").alias("vec_id"), cells.alias("cells"))
    return cells.select(
        "vec_id", F.when(large, stop).otherwise(F.col("cells").cast("array<int>")).alias("x")
    )


def first_centroids(vectors: DataFrame, number: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; a report of ``number`` rows."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "x").limit(number).collect()
    return np.array([row.x for row in first], np.int64)


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = x - point
    return np.einsum("ij,ij->i", apart, apart)


@dataclass(frozen=True)
class Pivots:
    points: np.ndarray
    pairs: list[tuple[int, int, float]]

    @classmethod
    def spread(cls, candidates: np.ndarray, number: int) -> Pivots:
        """Points far from each other: each next one is the farthest from those chosen."""
        chosen = [0]
        least = squared(candidates, candidates[0])
        while len(chosen) < number and least.max() > 0:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, squared(candidates, candidates[chosen[-1]]))
        points = candidates[chosen]
        near = np.sqrt(cls(points, []).distances(points))
        pairs = [(p, q, near[p, q]) for p, q in combinations(range(len(points)), 2)]
        return cls(points, pairs)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of each vector to each pivot."""
        return np.stack([squared(x, point) for point in self.points], axis=1)

    def bounds(self, near: np.ndarray, centre_near: np.ndarray) -> np.ndarray:
        """Never more than the squared distance of a vector to a centroid."""
        x, c = np.sqrt(near), np.sqrt(centre_near)
        best = np.zeros((len(x), len(c)))
        for p, q, apart in self.pairs:
            one, other = np.outer(x[:, p], c[:, q]), np.outer(x[:, q], c[:, p])
            gap = np.abs(one - other) - _SLACK * (one + other)
            np.maximum(best, gap / apart, out=best)
        return best * best * _SHRINK


def nearest(x: np.ndarray, near: np.ndarray, pivots: Pivots, centroids: np.ndarray):
    """(centroid, squared distance, distances computed) of each vector; of equals the first."""
    bounds = pivots.bounds(near, pivots.distances(centroids))
    best = bounds.argmin(axis=1)
    guess, rows = best.copy(), np.arange(len(x))
    apart = x - centroids[best]
    least = np.einsum("ij,ij->i", apart, apart)
    tried = len(x)
    for c, centroid in enumerate(centroids):
        open_rows = rows[(bounds[:, c] <= least) & (guess != c)]
        found = squared(x[open_rows], centroid)
        better = (found < least[open_rows]) | ((found == least[open_rows]) & (c < best[open_rows]))
        won = open_rows[better]
        best[won], least[won] = c, found[better]
        tried += len(open_rows)
    return best, least, tried


def _parts(batch: pa.RecordBatch):
    """(first row, vectors, squared pivot distances) of a few thousand rows at a time."""
    rows = batch.num_rows
    x = batch.column("x").flatten().to_numpy().reshape(rows, -1).astype(np.int64)
    near = batch.column("near").flatten().to_numpy().reshape(rows, -1)
    for first in range(0, rows, _ROWS_AT_ONCE):
        yield first, x[first : first + _ROWS_AT_ONCE], near[first : first + _ROWS_AT_ONCE]


def with_pivot_distances(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            near = pivots.distances(x.astype(np.int64))
            ends = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), lists], names=["vec_id", "x", "near"]
            )

    return vectors.mapInArrow(over, "vec_id long, x array<int>, near array<long>")


def moved(table: DataFrame, pivots: Pivots, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, x, near in _parts(batch):
                best, _, _ = nearest(x, near, pivots, centroids)
                member = np.zeros((len(x), len(centroids)))
                member[np.arange(len(x)), best] = 1
                counts += member.sum(axis=0).astype(np.int64)
                # Whole numbers below 2**53, so the product is exact.
                sums += (member.T @ x.astype(np.float64)).astype(np.int64)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full.astype(np.int32)),
                pa.array(counts[full]),
                pa.array(list(sums[full]), pa.list_(pa.int64())),
            ],
            names=["cluster", "members", "sums"],
        )

    parts = table.mapInArrow(over, "cluster int, members long, sums array<long>")
    totals = (
        parts.select("cluster", "members", F.posexplode("sums").alias("at", "part"))
        .groupBy("cluster", "at")
        .agg(F.sum("members").alias("members"), F.sum("part").alias("total"))
    )
    after = centroids.copy()
    for row in totals.collect():  # a row per centroid and component
        after[row.cluster, row.at] = row.total // row.members
    return after


def assigned(table: DataFrame, pivots: Pivots, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, near in _parts(batch):
                best, least, _ = nearest(x, near, pivots, centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(first, len(x)),
                        pa.array(best.astype(np.int32)),
                        pa.array(least),
                    ],
                    names=["vec_id", "cluster", "distance"],
                )

    return table.mapInArrow(over, "vec_id long, cluster int, distance long")


def clusters(
    rows: DataFrame, number: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector.

    ``rows`` has ``vec_id`` and ``embedding``.  Vectors that are null, have another number
    of components than ``size``, or a null or non-finite component give no row.  Rows that
    share an id, or have none, are vectors of their own; those without an id are never a
    first centroid unless too few have one, and equal hashes are ordered by the components.
    Fewer vectors than ``number`` give as many clusters; an empty table gives no rows.  A
    component of 2**27 / 256 or more stops the job, since distances would not fit a long.
    Other columns are ignored.
    """
    spark = rows.sparkSession
    tables = Workspace(spark)
    vectors = whole_vectors(rows, size)
    centroids = first_centroids(vectors, number)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    pivots = Pivots.spread(centroids, PIVOTS)
    table = tables.written(with_pivot_distances(vectors, pivots))
    for _ in range(rounds):
        centroids = moved(table, pivots, centroids)
    found = tables.written(assigned(table, pivots, centroids))
    own = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(own.values())
    digests = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    summary = spark.createDataFrame(
        [(c, inertia, total, digests[c]) for c, inertia in own.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # A row per centroid, whose number is a parameter.
    joined = found.join(F.broadcast(summary), "cluster")
    return joined.select(*(part.split()[0] for part in RESULT.split(", ")))
