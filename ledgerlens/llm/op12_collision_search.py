"""Approximate nearest neighbours by collision counting (query-aware hashing).

Every vector is projected on `PROJECTIONS` random lines, and each line keeps its projections as one sorted array.
Nothing is cut into fixed buckets: for a radius R the bucket of a query on a line is the window of half-width
`HALF` x R around the query's own projection, so enlarging R (virtual rehashing) only moves the ends of the windows.
A vector that lies in the windows of at least `threshold` lines collides often enough, and its distance is
computed in double precision. Radii grow until `k` vectors within R are known.

Why this finds what it promises: a vector at distance at most R falls into a window with probability of at least
p = P(|N(0, 1)| <= HALF), independently for each line, and the threshold is the largest count that a binomial of
`PROJECTIONS` draws with p reaches with probability `RECALL`. A search ends only when its kth found vector is
within R, so each true neighbour nearer than that was verified with that probability. There is no cap on candidates:
a search that doesn't end early goes on until the windows hold everything.

The index is local to segments of at most `SEGMENT` vectors, built where the vectors are read: no vector is shuffled,
every row is indexed, and a task holds one segment, whatever the size of its partition. The queries go to all
segments in blocks of `QUERIES`, a pass over the table for each block; a task keeps the k best of each query, which
also bound the radius in its later segments, and only those leave it.

Defined results: vectors that are null, zero or hold a null or non-finite component, and rows with a null id, take no
part; a query meets vectors of its own length only; rows that repeat a vector are candidates like any other, ties go
to the smaller id; rows with the query's own id are never its neighbours, and if queries repeat an id each of them gets
its rows. A query with fewer than k candidates gets all. Other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .vectors import finite, matrices, query_blocks, segments

PROJECTIONS = 32
HALF = 1.7
RECALL = 0.95
#: A radius grows by so much while fewer than k vectors are known, and afterwards.
GROWTH = (1.6, 1.12)
SEGMENT = 1 << 15
QUERIES = 1 << 14
NEIGHBOURS = 10
EVERY = 100
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def threshold(projections: int = PROJECTIONS, half: float = HALF, recall: float = RECALL) -> int:
    """The largest count of collisions that a vector at distance R reaches with probability `recall`."""
    p = math.erf(half / math.sqrt(2))
    missing = 0.0
    for c in range(projections + 1):
        missing += math.comb(projections, c) * p**c * (1 - p) ** (projections - c)
        if missing > 1 - recall:
            return c
    return projections


def lines(dimension: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Directions of the projections, the same in every task."""
    return np.random.default_rng([dimension, projections]).standard_normal((dimension, projections))


@dataclass
class Nearest:
    """The k best rows of one query so far, by (distance, id)."""

    k: int
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    distances: np.ndarray = field(default_factory=lambda: np.empty(0))

    def add(self, ids: np.ndarray, distances: np.ndarray) -> None:
        if self.bound() < math.inf:
            near = distances <= self.bound()
            ids, distances = ids[near], distances[near]
        if ids.size:
            ids, distances = np.concatenate([self.ids, ids]), np.concatenate([self.distances, distances])
            best = np.lexsort((ids, distances))[: self.k]
            self.ids, self.distances = ids[best], distances[best]

    def bound(self) -> float:
        """No row beyond this distance is among the k best."""
        return float(self.distances[-1]) if self.ids.size >= self.k else math.inf


class Index:
    """Sorted projections of the vectors of one segment."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors = ids, vectors
        at = vectors @ directions
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(at.T, self.order, axis=1))
        #: Equal vectors may differ by rounding in their projections.
        self.slack = 1e-9 * float(np.abs(at).max(initial=0.0))

    def windows(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each line, the range of the sorted array within `half` of the query."""
        lo = [s.searchsorted(c - half) for s, c in zip(self.sorted, centre)]
        hi = [s.searchsorted(c + half, "right") for s, c in zip(self.sorted, centre)]
        return np.array(lo), np.array(hi)

    def first_radius(self, centre: np.ndarray, k: int) -> float:
        """About k vectors are in the window of a middling line."""
        n = self.ids.size
        at = np.array([s.searchsorted(c) for s, c in zip(self.sorted, centre)])
        rows = np.arange(centre.size)
        return float(np.median(self.sorted[rows, np.minimum(at + k, n - 1)] - self.sorted[rows, np.maximum(at - k, 0)])) / 2

    def search(self, query_id: int, query: np.ndarray, centre: np.ndarray, least: int, best: Nearest, half: float = HALF) -> None:
        """Add what collides with the query on `least` lines or more, radius after radius, to `best`."""
        n, m = self.ids.size, centre.size
        inside = np.zeros(n, np.int64)
        lo = hi = self.windows(centre, -1.0)[0]
        seen = np.zeros(n, bool)
        radius = min(self.first_radius(centre, best.k) / half, best.bound())
        while True:
            new_lo, new_hi = self.windows(centre, half * radius + self.slack)
            covered = int((new_hi - new_lo).sum())
            if 2 * covered <= n * m:  # count what came into the windows since the last radius
                flanks = [o[a:b] for o, a, b, c, d in zip(self.order, new_lo, lo, hi, new_hi)] + [o[c:d] for o, c, d in zip(self.order, hi, new_hi)]
                inside += np.bincount(np.concatenate(flanks), minlength=n)
                lo, hi = new_lo, new_hi
                collisions = inside
            else:  # count what is still outside, which is less
                outside = [o[:a] for o, a in zip(self.order, new_lo)] + [o[b:] for o, b in zip(self.order, new_hi)]
                collisions = m - np.bincount(np.concatenate(outside), minlength=n)
            found = np.flatnonzero((collisions >= least) & ~seen)
            seen[found] = True
            found = found[self.ids[found] != query_id]
            if found.size:
                best.add(self.ids[found], np.sqrt(((self.vectors[found] - query) ** 2).sum(axis=1)))
            bound = best.bound()
            if radius >= bound or covered == n * m:
                return
            radius = min(radius * GROWTH[bound < math.inf] or self.slack or 1e-300, bound)


def _searched(block: pa.Table, k: int):
    """Of each partition, the k best rows of each query of the block."""
    least = threshold()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = block.column("vec_id").to_numpy(), block.column("query").to_numpy()
        asked = {q.shape[1]: (rows, q.astype(float)) for rows, q in matrices(block.column("embedding"))}
        centres = {d: q @ lines(d) for d, (_, q) in asked.items()}
        best = [Nearest(k) for _ in range(block.num_rows)]
        for part in segments(batches, SEGMENT):
            ids = part.column("vec_id").to_numpy()
            for rows, vectors in matrices(part.column("embedding")):
                d = vectors.shape[1]
                if d not in asked:
                    continue
                index = Index(ids[rows], vectors.astype(float), lines(d))
                for i, query, centre in zip(asked[d][0].tolist(), asked[d][1], centres[d]):
                    index.search(int(names[i]), query, centre, least, best[i])
        for start in range(0, len(best), 1000):
            some = range(start, min(start + 1000, len(best)))
            counts = [best[i].ids.size for i in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(numbers[some], counts)), pa.array(np.repeat(names[some], counts)), pa.array(np.concatenate([best[i].ids for i in some])), pa.array(np.concatenate([best[i].distances for i in some]))],
                schema=_FOUND,
            )

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row of `vectors` (vec_id, embedding) that `is_query` names."""
    nonzero = F.exists("embedding", lambda x: x.cast("double") != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & nonzero)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.where(is_query).withColumn("query", F.monotonically_increasing_id())
    found = None
    for block in query_blocks(asked, QUERIES, "nearest"):
        now = rows.mapInArrow(_searched(block, k), "query long, query_id long, vec_id long, score double")
        found = now if found is None else found.union(now)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
