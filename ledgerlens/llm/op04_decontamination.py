"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: lower case, runs of other characters than letters and
digits become one space. An item of m characters may occur with up to
``budget(m) = m // PIECE - 1`` edits (at least 0). It is cut into budget + 1 pieces; an occurrence
within the budget leaves at least one piece intact, so exact piece hits (one Aho-Corasick pass
over each whole text) find all places to look at. Windows around the hits are verified with
Myers' bit-parallel edit distance of the whole item against any part of the window.

The items are a stated query set. They go to the tasks in blocks of at most about `BLOCK`
characters, one pass over the documents per block, so what is sent does not grow with the
benchmark. Documents are never shuffled.

An item of fewer than `PIECE` normalised characters allows no edit and is one piece; it is found
where it stands exactly between word bounds, so that a short answer isn't found inside a word.

Defined results: null and empty texts or items match nothing; equal items and repeated
documents are each reported; of several places the one with the fewest edits counts, then the
first. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

PIECE = 20
#: The automaton takes about 60 bytes a character, as measured, in each Python worker.
BLOCK = 1_000_000

_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(length: int) -> int:
    return max(0, length // PIECE - 1)


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece), budget + 1 of them, of nearly equal length."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best approximate occurrence of `item` in `text`, the first on ties; None if all need more than `most` edits."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def _between_words(text: str, start: int, end: int) -> bool:
    return (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            for at, piece in pieces(t):
                places[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, end) for each item that occurs in the normalised text."""
        if not self.items:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, where) in self.automaton.iter(text):
            for k, at in where:
                start = end + 1 - length - at
                if len(self.items[k][1]) >= PIECE or _between_words(text, start, end + 1):
                    starts[k].add(start)
        out = []
        for k, guesses in sorted(starts.items()):
            item_id, item = self.items[k]
            best = next(((0, s + len(item)) for s in sorted(guesses) if s >= 0 and text.startswith(item, s)), None)
            if best is None:
                best = self._near(item, text, sorted(guesses))
            if best is not None:
                out.append((item_id, *best))
        return out

    @staticmethod
    def _near(item: str, text: str, guesses: list[int]) -> tuple[int, int] | None:
        most = budget(len(item))
        best, lo, hi = None, None, None
        for s in [*guesses, None]:
            a, b = (None, None) if s is None else (max(0, s - most), min(len(text), s + len(item) + most))
            if lo is not None and (s is None or a > hi):
                got = myers(item, text[lo:hi], most)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
                lo = None
            lo, hi = (a, b) if lo is None else (lo, max(hi, b))
        return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield [(r["item_id"], normalise(r["text"])) for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, budget, end (in the normalised text): one row per document and test item that it contains."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits long, budget long, end long"
    out = None
    for items in _blocks(benchmark):
        if not any(t for _, t in items):
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            allowed = {}
            for i, t in sent.value:
                allowed.setdefault(i, budget(len(t)))
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                found = [(d, i, e, allowed[i], end) for d, t in zip(ids, texts, strict=True) for i, e, end in matcher.find(normalise(t))]
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "budget", "end"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text contains no test item."""
    for items in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                clean = [not matcher.find(normalise(t)) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
