"""Language identification by the nearest of several centroids per language.

A text is a vector of character 1- to 3-grams (lower-cased, other characters than letters
collapsed into word edges), hashed into `DIMS` places: log term frequency times inverse
document frequency, scaled to length 1. Each language has up to `CLUSTERS` centroids, found
by spherical k-means. The language of the centroid with the largest cosine wins.

Rejection is for texts of none of the learned languages: `lang_pred` still names the nearest one, and
`rejected` tells that even it is too far. A text is rejected if its best cosine is lower than `SLACK` times
the lowest that training texts of about as many letters have to the centroids of their own
language. Texts that mix learned languages, and junk in a learned one, are within that; other scripts
and other languages of the same script are not. Of texts with too few letters to have been learned
from (less than the shortest class of lengths with `ENOUGH` training texts) none is rejected.

Training reads at most about `PER_LANGUAGE` labelled rows of each language and `TRAIN_ROWS` in all (picked by
a hash of the id, so the same rows at any partitioning), of the `LANGUAGES` most frequent languages; its
vectors, not its texts, reach the driver.

Defined results: null texts and texts without a letter get `und`, score 0 and are rejected.
Null languages are not learned. If there is nothing to learn from, all rows are `und`.
Repeated rows are scored alike; equal cosines go to the first language in order. Only
doc_id, text and (for training) lang are read; other columns are ignored; an empty table
gives no rows. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out
from .textnum import buffers, chars_are, codes_of

DIMS_BITS = 13
DIMS = 1 << DIMS_BITS
#: The bound of the training sample: labelled rows of each language.
PER_LANGUAGE = 1000
TRAIN_ROWS = 40_000
LANGUAGES = 400
CLUSTERS = 4
SLACK = 0.35
ENOUGH = 20
UNKNOWN = "und"
_DOCS = 128


def gram_counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each buffer: the index of its first text, n-gram counts and letters per text."""
    lowered = [(t or "").lower() for t in texts]
    for lo, hi in buffers(lowered, _DOCS):
        codes = codes_of("\x00" + "".join(t + "\x00" for t in lowered[lo:hi]))
        letter = chars_are("isalpha", codes)
        doc = np.concatenate([[0], np.repeat(np.arange(hi - lo, dtype=np.int32), [len(t) + 1 for t in lowered[lo:hi]])])
        # letters, and one edge before, between and after words (texts next to each other share one)
        near = letter.copy()
        near[1:] |= letter[:-1]
        near[:-1] |= letter[1:]
        c, doc, letter = codes[near].astype(np.uint64), doc[near], letter[near]
        once = letter.copy()
        once[:1] = True
        once[1:] |= letter[:-1]
        c, doc = np.where(letter, c, np.uint64(0))[once], doc[once]
        inner = c != 0
        place = [np.empty(0, np.int64)]
        h = c * np.uint64(0x9E3779B97F4A7C15)
        place.append(_place(h, doc, inner))
        if c.size > 1:
            two = h[:-1] * np.uint64(31) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
            inside = inner[:-1] | inner[1:]
            place.append(_place(two, np.where(inner[:-1], doc[:-1], doc[1:]), inside))
        if c.size > 2:
            three = two[:-1] * np.uint64(31) + c[2:] * np.uint64(0x165667B19E3779F9)
            place.append(_place(three, doc[1:-1], inner[1:-1]))
        counts = np.bincount(np.concatenate(place), minlength=(hi - lo) * DIMS).reshape(hi - lo, DIMS)
        yield lo, counts.astype(np.float32), np.bincount(doc[inner], minlength=hi - lo)


def _place(h: np.ndarray, doc: np.ndarray, keep: np.ndarray) -> np.ndarray:
    h = h[keep] ^ (h[keep] >> np.uint64(29))
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - DIMS_BITS)
    return (doc[keep].astype(np.int64) << DIMS_BITS) + h.astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # by bits of the number of letters: the least cosine that isn't rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.maximum(norm, 1e-9)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """The largest cosine to each language."""
        cos = self.vectors(counts) @ self.centroids.T
        return np.stack([cos[:, self.of == k].max(axis=1) for k in range(len(self.languages))], axis=1)


def _bits(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), 31)


def _cluster(x: np.ndarray, k: int, rounds: int = 12, least: float = 0.05) -> np.ndarray:
    """Spherical k-means from seeds drawn by squared distance (a fixed draw). Clusters of fewer than
    `least` of the texts, mostly notices and mixed languages, give no centroid unless there is no other."""
    rng = np.random.default_rng(11)
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[seeds].T).max(axis=1).astype(float), 0) ** 2
        if far.sum() <= 1e-12:
            break
        seeds.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) for j in range(len(c)) if (own == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    large = size >= least * len(x)
    return c[large] if large.any() else c


def _train_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        for lo, counts, letters in gram_counts(batch.column("text").to_pylist()):
            rows = []
            for i, (row, n) in enumerate(zip(counts, letters, strict=True)):
                if n:
                    at = np.flatnonzero(row)
                    rows.append((ids[lo + i], langs[lo + i], int(n), at.astype("<u2").tobytes(), row[at].astype("<f4").tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "lang", "n", "at", "tf"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Model | None:
    """Learn from rows with a language whose id is not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # at most LANGUAGES rows
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    per_language = min(per_language, TRAIN_ROWS // len(sizes))
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / n))])
    # by id and text, so that the rows of one id are drawn one by one; repeats of a row count once, and chance may not go beyond the bound
    luck = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id"), F.col("text")), F.lit(1_000_000)) / 1_000_000
    sample = usable.where(luck < share[F.col("lang")]).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").dropDuplicates()
    sample = sample.orderBy(F.xxhash64("text", "doc_id")).limit(TRAIN_ROWS + TRAIN_ROWS // 4)
    got = sample.mapInArrow(_train_rows, "doc_id long, lang string, n long, at binary, tf binary").collect()
    rows = sorted(got, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["n"], bytes(r["at"])))
    if not rows:
        return None
    df = np.bincount(np.concatenate([np.frombuffer(r["at"], "<u2") for r in rows]), minlength=DIMS)
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    model = Model(sorted({r["lang"] for r in rows}), np.empty(0, int), np.empty((0, DIMS), np.float32), idf, np.zeros(32))
    of, centroids, near, bits = [], [], [], []
    for k, lang in enumerate(model.languages):
        own = [r for r in rows if r["lang"] == lang]
        x = np.zeros((len(own), DIMS), np.float32)
        for row, r in zip(x, own, strict=True):
            row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["tf"], "<f4")
        x = model.vectors(x)
        c = _cluster(x, clusters)
        of += [k] * len(c)
        centroids.append(c)
        near.append((x @ c.T).max(axis=1))
        bits.append(_bits(np.array([r["n"] for r in own])))
    model.of, model.centroids = np.array(of), np.concatenate(centroids).astype(np.float32)
    near, bits = np.concatenate(near), np.concatenate(bits)
    known = 0.0  # longer texts than any class that was learned are held to the last one's floor
    for b in range(32):
        if (bits == b).sum() >= ENOUGH:
            known = SLACK * near[bits == b].min()
        model.floor[b] = known
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred (the nearest language, or `und`), score (its cosine), margin (to the next), rejected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, margin, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
            if model is not None:
                for lo, counts, letters in gram_counts(batch.column("text").to_pylist()):
                    best = model.best(counts)
                    top = np.sort(best, axis=1)
                    some = letters > 0
                    at = lo + np.flatnonzero(some)
                    for i, k in zip(at, best[some].argmax(axis=1), strict=True):
                        lang[i] = model.languages[k]
                    score[at] = np.clip(top[some, -1], 0, 1)
                    margin[at] = top[some, -1] - (top[some, -2] if top.shape[1] > 1 else 0)
                    rejected[at] = top[some, -1] < model.floor[_bits(letters[some])]
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(margin), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not rejected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            if model is not None:
                texts = batch.column("text").cast(pa.string()).to_pylist()
                for lo, counts, letters in gram_counts(texts):
                    near = model.best(counts).max(axis=1)
                    keep[lo : lo + len(near)] = (letters > 0) & (near >= model.floor[_bits(letters)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
