"""Document fingerprints by winnowing.

White space is dropped and A-Z lower-cased. Every run of `K` characters (k-gram) is hashed by a
rolling polynomial; of every `WINDOW` consecutive k-grams the one with the smallest hash is
chosen, the rightmost on ties. The fingerprint lists the chosen hashes with the places of their
k-grams among the kept characters, so two texts that share a run of at least K + WINDOW - 1 such
characters share a fingerprint entry there. Likeness is the Jaccard similarity of the sets of
chosen hashes.

`compare_edited` needs each document's successor in descending order of ids. Ids are cut into
chunks at quantiles (at most `CHUNKS`, so that is all the driver holds); a document goes to its own
chunk, and the first one of a chunk also to the chunk before it, for whose last document it is the
successor. Whole texts are shuffled once and stream through sorted; a task holds one batch and
one row more. The chunks do not depend on how the input is split, and a lost task is redone alone.

Defined results: null texts count as empty; an empty fingerprint is the empty string; texts of
fewer than K kept characters have one entry, of all they have; two empty fingerprints are
alike (1), an empty and another one are not (0). Null ids come last. Rows of equal id follow
each other in order of their texts. A single document follows itself. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .textnum import codes_of, mix

K = 16
WINDOW = 24
CHUNKS = 4096
ROWS = 32
_PLACE = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15


def _grams(c: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, by doubling the length."""
    out, length = c, 1
    done, have = None, 0
    rest = k
    while rest:
        if rest & 1:
            if done is None:
                done, have = out, length
            else:
                n = c.size - have - length + 1
                done = done[:n] * np.uint64(pow(_FACTOR, length, 1 << 64)) + out[have : have + n]
                have += length
        rest >>= 1
        if rest:
            n = out.size - length
            out = out[:n] * np.uint64(pow(_FACTOR, length, 1 << 64)) + out[length:]
            length *= 2
    return mix(done)


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    length = 1
    while length * 2 <= w:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return np.minimum(x[: x.size - (w - length)], x[w - length :]) if w > length else x


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 40 bits, places) of the chosen k-grams, in order."""
    codes = codes_of(text)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0x85) | (codes == 0xA0)
    c = codes[~space].astype(np.uint64)
    none = np.empty(0, np.uint64)
    if not c.size:
        return none, none
    c += np.where((c >= 65) & (c <= 90), np.uint64(33), np.uint64(1))
    k = min(k, c.size)
    total = c.size - k + 1
    w = min(window, total)
    hashes, places, last = [], [], -1
    for lo in range(0, total - w + 1, _BLOCK):  # windows that start in a block
        part = c[lo : min(lo + _BLOCK, total - w + 1) + w + k - 2]
        h = _grams(part, k) >> np.uint64(24)
        at = np.arange(h.size, dtype=np.uint64)
        least = _slide((h << np.uint64(24)) | (_PLACE - at), w)
        chosen = least[np.flatnonzero(np.diff(least, prepend=~least[:1]))]
        place = (_PLACE - (chosen & _PLACE)) + np.uint64(lo)
        keep = place > np.uint64(last) if last >= 0 else np.ones(place.size, bool)
        hashes.append(chosen[keep] >> np.uint64(24))
        places.append(place[keep])
        if keep.any():
            last = int(places[-1][-1])
    return np.concatenate(hashes), np.concatenate(places)


def as_string(hashes: np.ndarray, places: np.ndarray) -> str:
    return ",".join([f"{h:010x}@{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def likeness(a: set[int], b: set[int]) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_string(*winnow(t)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, guest, id (descending) and text: each but the guests with its successor."""
    names = [x.split()[0] for x in _COMPARED.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    waiting = None  # (chunk, id, text, fingerprint, set)
    for batch in batches:
        out, size = [], 0
        chunks, guests, ids, texts = (batch.column(c).to_pylist() for c in ("chunk", "guest", "doc_id", "text"))
        for chunk, guest, doc_id, text in zip(chunks, guests, ids, texts, strict=True):
            text = text or ""
            if guest and (waiting is None or waiting[0] != chunk):
                continue  # only the first guest is a successor
            own = winnow(text)
            print_, seen = as_string(*own), set(own[0].tolist())
            if waiting is not None and waiting[0] == chunk:
                _, i, t, p, s = waiting
                e = edited(t, text)
                other = winnow(e)
                out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), p, as_string(*other), likeness(s, set(other[0].tolist())), likeness(s, seen)))
                size += len(p)
            waiting = None if guest else (chunk, doc_id, text, print_, seen)
            if size > 1 << 22:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, and its likeness to that of the edited text and of the successor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.select("doc_id")
    n = ids.count()
    chunks = max(1, min(CHUNKS, n // ROWS))
    shares = [i / chunks for i in range(1, chunks)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * CHUNKS).alias("q")).first()["q"] if shares else None
    cuts = np.unique(np.array(found or [], np.int64))

    def own_chunk(i: pa.Array) -> np.ndarray:
        # null ids come after the smallest
        return np.searchsorted(cuts, i.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left").astype(np.int32)

    @F.arrow_udf("int")
    def chunk_of(i: pa.Array) -> pa.Array:
        return pa.array(own_chunk(i))

    # at most CHUNKS rows
    tops = sorted((r["c"], r["top"]) for r in ids.groupBy(chunk_of("doc_id").alias("c")).agg(F.max("doc_id").alias("top")).collect())
    # the first document of each chunk also goes to the next higher chunk, that of the highest to the lowest
    to = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}

    @F.arrow_udf("array<int>")
    def chunks_of(i: pa.Array) -> pa.Array:
        return pa.array([[c, to[x]] if x in to else [c] for c, x in zip(own_chunk(i).tolist(), i.to_pylist(), strict=True)], pa.list_(pa.int32()))

    dealt = rows.select("doc_id", "text", F.posexplode(chunks_of("doc_id")).alias("guest", "chunk"))
    ordered = dealt.repartition("chunk").sortWithinPartitions("chunk", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_compare, _COMPARED)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))
