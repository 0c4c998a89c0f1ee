"""Vectors shared by the operators on embeddings: which rows count, blocks of queries, matrices of batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def finite(vector: Column) -> Column:
    """True for a vector whose components are all there and finite (an empty one included)."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def query_blocks(queries: DataFrame, most: int, tag: str) -> Iterator[pa.Table]:
    """The rows of `queries` in Arrow tables of about `most` rows each, one in the driver at a time.

    The queries are written once, dealt evenly over as many blocks as their number takes.
    """
    queries = materialize(queries, f"{tag}-queries")
    n = queries.count()
    if not n:
        return
    count = -(-n // most)
    dealt = queries.repartition(count).withColumn("_block", F.spark_partition_id())
    if count > 1:
        dealt = materialize(dealt, f"{tag}-blocks")
    for block in range(count):
        yield dealt.where(F.col("_block") == block).drop("_block").toArrow()


def matrices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length among the vectors of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)]


def segments(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a stream in tables of `most` rows (the last one shorter)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
