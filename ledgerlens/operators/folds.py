"""Greedy folds along a document: chunks, batches and prose blocks.

Each is a small function of one text; Spark deals the documents out and streams them through
Arrow, so no document meets another and a task holds one batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = re.compile(r"(?<=[.!?])\s+")


def chunks_of(text: str, size: int) -> list[tuple[int, int]]:
    """Cuts at `size` characters, or at the last line break or full stop beyond the half."""
    out, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        if hi < len(text):
            cut = max(text.rfind("\n", lo + size // 2, hi), text.rfind(".", lo + size // 2, hi))
            hi = cut + 1 if cut >= 0 else hi
        out.append((lo, hi))
        lo = hi
    return out


def batches_of(sizes: list[int], most: int, extra: int = 96) -> list[int]:
    """The batch of each block: a block that doesn't fit opens the next batch."""
    out, batch, used = [], 0, 0
    for n in sizes:
        if used and used + n + extra > most:
            batch, used = batch + 1, 0
        used += n + extra
        out.append(batch)
    return out


def blocks_of(text: str, most: int) -> list[str]:
    """Paragraphs longer than `most` split at sentence ends by running length."""
    out = []
    for para in text.split("\n"):
        if len(para) <= most:
            out.append(para)
            continue
        now = ""
        for s in _END.split(para):
            if now and len(now) + 1 + len(s) > most:
                out.append(now)
                now = s
            else:
                now = f"{now} {s}" if now else s
        out.append(now)
    return [x for x in out if x.strip()]


def _rows(docs: DataFrame, f, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in f(i, t or "")]
            cols = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def chunk_pack(docs: DataFrame, size: int = 2000) -> DataFrame:
    kinds = [pa.int64()] * 4
    return _rows(docs, lambda i, t: [(i, n, a, b) for n, (a, b) in enumerate(chunks_of(t, size))], "doc_id long, chunk long, start long, end long", ["doc_id", "chunk", "start", "end"], kinds)


def selection_batches(docs: DataFrame, most: int = 4000) -> DataFrame:
    def f(i: int, t: str) -> list[tuple]:
        blocks = [b for b in t.split("\n") if b.strip()]
        return [(i, n, b) for n, b in enumerate(batches_of([len(b) for b in blocks], most))]

    return _rows(docs, f, "doc_id long, block long, batch long", ["doc_id", "block", "batch"], [pa.int64()] * 3)


def prose_blocks(docs: DataFrame, most: int = 260) -> DataFrame:
    return _rows(docs, lambda i, t: [(i, n, len(b)) for n, b in enumerate(blocks_of(t, most))], "doc_id long, block long, chars long", ["doc_id", "block", "chars"], [pa.int64()] * 3)
