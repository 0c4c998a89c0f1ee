"""Hard-negative mining by distributed radix selection.

An anchor's positives are its best rows of the same label; for each of them, hard negatives are the best rows of other
labels whose score lies in a window just below the positive's (80 to 100 % of it). Scores are integer inner
products, so the kth best row of a window is found without sorting or gathering candidates: every task counts
the scores of a window in `BINS` equal bins, the counts are summed, and the bin that holds the kth score
becomes the next range, digit by digit, until bins are one score wide or so few rows are left that they can be read.
Only rows that reach the located score are gathered then, and of each window a task hands on no more than its
own k best, so ties of any number (copies of one vector) are settled by id within bounded memory.

Positives and negatives are both such windows (`Windows`: a row of each anchor or of each anchor and positive, with the
range of its scores and whether labels must be equal or differ). Anchors go to all rows in blocks of `ANCHORS`; a block takes
two to four passes for each of the two kinds, each a scan that shuffles only counts of windows.

Scores are exact: components are integers, products are summed in doubles while they stay below 2^53, else in Python's
integers, clipped to what a long can hold.

Defined results: rows with a null id, label or vector or a null component take no part (for floating-point
components also those that aren't finite); an anchor meets vectors of its own length only; rows with the anchor's own id are
never its positives or negatives; rows that repeat an id are candidates like any other, and an anchor row that repeats
one gets its own windows; windows without rows give none. Other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .vectors import finite, matrices, query_blocks

BINS = 64
POSITIVES = NEGATIVES = 5
#: A negative scores at most as much as the positive, and at most a fifth of that less.
FIFTH = 5
ANCHORS = 1 << 12
#: Scores that are held at once in a task.
HELD = 1 << 21
#: A window isn't refined further once so many rows at most reach its bin.
FEW = 64
EVERY = 100
SCALE = 256
_LONG = np.iinfo(np.int64)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows with all anchors."""
    d = rows.shape[1]
    most = float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(anchors.astype(float)).max(initial=0)) * d
    if most < 2**53:
        return (rows.astype(float) @ anchors.astype(float).T).astype(np.int64)
    return np.clip(rows.astype(object) @ anchors.astype(object).T, _LONG.min, _LONG.max).astype(np.int64)


@dataclass
class Windows:
    """Windows of scores, each of one anchor: low <= score <= high."""

    anchor: np.ndarray  # rows of the block
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return self.anchor.size


class Block:
    """Anchors by the length of their vectors, and the scores of a batch of rows with them."""

    def __init__(self, anchors: pa.Table):
        self.ids = anchors.column("vec_id").to_numpy()
        self.labels = anchors.column("label").to_numpy()
        self.vectors = {v.shape[1]: (rows, v) for rows, v in matrices(anchors.column("vector"))}

    def candidates(self, batch: pa.RecordBatch, windows: Windows, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, score, id) of the rows of the batch that are in a window; `same`: labels must be equal, else differ."""
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        of_anchor = np.argsort(windows.anchor, kind="stable")
        begin = np.searchsorted(windows.anchor[of_anchor], np.arange(self.ids.size + 1))
        low, high = np.full(self.ids.size, _LONG.max), np.full(self.ids.size, _LONG.min)
        np.minimum.at(low, windows.anchor, windows.low)
        np.maximum.at(high, windows.anchor, windows.high)
        for rows, vectors in matrices(batch.column("vector")):
            if vectors.shape[1] not in self.vectors:
                continue
            at, anchors = self.vectors[vectors.shape[1]]
            step = max(1, HELD // max(at.size, 1))
            for s in range(0, rows.size, step):
                part = rows[s : s + step]
                scores = products(vectors[s : s + step], anchors)
                fit = (scores >= low[at]) & (scores <= high[at]) & (ids[part][:, None] != self.ids[at]) & ((labels[part][:, None] == self.labels[at]) == same)
                row, col = np.nonzero(fit)
                score, anchor = scores[row, col], at[col]
                # every window of the anchor, one after another
                for k in range(int(np.diff(begin).max(initial=0))):
                    has = begin[anchor] + k < begin[anchor + 1]
                    window = of_anchor[begin[anchor[has]] + k]
                    inside = (score[has] >= windows.low[window]) & (score[has] <= windows.high[window])
                    yield window[inside], score[has][inside], ids[part[row[has][inside]]]


def _counted(block: Block, windows: Windows, same: bool, width: np.ndarray) -> Callable:
    """Counts of scores below the upper end of each window by bins of its `width`."""
    schema = pa.schema([("window", pa.int64()), *((f"b{i}", pa.int64()) for i in range(BINS))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(windows), BINS), np.int64)
        for batch in batches:
            for window, score, _ in block.candidates(batch, windows, same):
                # the distance from the upper end may take all 64 bits
                bins = (windows.high[window].astype(np.uint64) - score.astype(np.uint64)) // width[window]
                np.add.at(counts, (window, bins.astype(np.int64)), 1)
        some = np.flatnonzero(counts.any(axis=1))
        for s in range(0, some.size, 4096):
            yield pa.RecordBatch.from_arrays([pa.array(some[s : s + 4096]), *(pa.array(c) for c in counts[some[s : s + 4096]].T)], schema=schema)

    return count


def located(rows: DataFrame, block: Block, windows: Windows, same: bool, k: int) -> Windows:
    """The same windows, cut from below to the scores of their k best rows, or to a few more; one without rows becomes empty."""
    # differences of longs are taken without sign, so they can't overflow
    bottom, top = windows.low.astype(np.uint64), windows.high.astype(np.uint64)
    ahead = np.zeros(len(windows), np.int64)  # rows above the range that is searched
    empty = windows.low > windows.high
    at = np.flatnonzero(~empty)
    sums = [F.sum(f"b{i}").alias(f"b{i}") for i in range(BINS)]
    while at.size:
        span = top[at] - bottom[at]
        width = span // np.uint64(BINS) + np.uint64(1)
        now = Windows(windows.anchor[at], bottom[at].astype(np.int64), top[at].astype(np.int64))
        got = rows.mapInArrow(_counted(block, now, same, width), "window long, " + ", ".join(f"b{i} long" for i in range(BINS))).groupBy("window").agg(*sums).toArrow()
        counts = np.zeros((at.size, BINS), np.int64)
        counts[got.column("window").to_numpy()] = np.stack([got.column(f"b{i}").to_numpy() for i in range(BINS)], axis=1)
        upto = ahead[at][:, None] + np.cumsum(counts, axis=1)
        short = upto[:, -1] < k  # not k rows in all: everything in the window qualifies
        digit = np.where(short, 0, (upto >= k).argmax(axis=1))
        upto = upto[np.arange(at.size), digit]
        offset = digit.astype(np.uint64) * width
        inner = np.where(span - offset < width, bottom[at], top[at] - offset - width + np.uint64(1))
        bottom[at] = np.where(short, bottom[at], inner)
        empty[at] = short & ~counts.any(axis=1) & (ahead[at] == 0)
        done = short | (upto <= max(k, FEW)) | (width == 1)
        ahead[at] = upto - counts[np.arange(at.size), digit]
        top[at] = top[at] - offset
        at = at[~done]
    return Windows(windows.anchor, np.where(empty, _LONG.max, bottom.astype(np.int64)), np.where(empty, _LONG.min, windows.high))


def _gathered(block: Block, windows: Windows, same: bool, k: int) -> Callable:
    """Of each window, the k best rows of each task."""
    schema = pa.schema([("window", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = tuple(np.empty(0, np.int64) for _ in range(3))
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for found in block.candidates(batch, windows, same):
                held.append(found)
                if sum(h[0].size for h in held) > HELD:
                    best, held = _best([best, *held], k), []
        best = _best([best, *held], k)
        if best[0].size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], schema=schema)

    return gather


def _best(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The first k of each window by falling score and rising id."""
    window, score, ids = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((ids, ~score, window))
    window, score, ids = window[order], score[order], ids[order]
    starts = np.flatnonzero(np.diff(window, prepend=-1))
    rank = np.arange(window.size) - np.repeat(starts, np.diff(starts, append=window.size))
    return window[rank < k], score[rank < k], ids[rank < k]


def select(rows: DataFrame, block: Block, windows: Windows, same: bool, k: int) -> DataFrame:
    """(window, rank, score, vec_id) of the first k of each window, which is named by its place."""
    cut = located(rows, block, windows, same, k)
    found = rows.mapInArrow(_gathered(block, cut, same, k), "window long, score long, vec_id long")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors among `rows`
    (vec_id, label, vector of integers)."""
    spark = rows.sparkSession
    square = lambda s, x: s + x.cast("double") * x.cast("double")
    longest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), square))).first()[0]
    out = None
    for anchors in query_blocks(rows.where(is_anchor), ANCHORS, "anchors"):
        block = Block(anchors)
        ours = max(float((v.astype(float) ** 2).sum(axis=1).max(initial=0)) for _, v in block.vectors.values())
        bound = min(int((longest * ours) ** 0.5 * 1.001) + 1, int(_LONG.max))  # no score is larger in size
        n = block.ids.size
        near = select(rows, block, Windows(np.arange(n), np.full(n, -bound), np.full(n, bound)), True, positives).toArrow()  # at most `positives` of each anchor
        anchor, score = near.column("window").to_numpy(), near.column("score").to_numpy()
        # 80 P <= 100 N for integers is N >= P - floor(P / 5)
        below = Windows(anchor, score - score // FIFTH, score)
        names = pa.table({"window": np.arange(len(below)), "anchor_id": block.ids[anchor], "positive_id": near.column("vec_id").to_numpy(), "positive_score": score})
        found = select(rows, block, below, False, negatives).join(F.broadcast(spark.createDataFrame(names)), "window")
        now = found.selectExpr("anchor_id", "positive_id", "rank", "vec_id AS negative_id", "positive_score", "score AS negative_score")
        out = now if out is None else out.union(now)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, components as floor(256 x)."""
    whole = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("vector"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % EVERY == 0)


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM n WHERE rank <= 5
"""
