"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` code points (the last may be shorter). A passage is
described by shares of kinds of characters, word lengths, repetition within it and across the
document, and a hashed histogram of character pairs; a learned layer encodes that into
`HIDDEN` values. Gated attention, exp(w . (tanh(V h) * sigmoid(U h))) normalised over the document's
passages, weighs them; the weighted mean is scored by a logistic unit. All of it is learned
together from document labels only, by Adam on the cross-entropy.

Training reads at most about `TRAIN_ROWS` labelled documents (picked by a hash of the id) and of each at
most `TRAIN_PASSAGES` passages, evenly spaced; their features, not their texts, reach the driver.
Scoring reads all passages of all documents and needs no shuffle.

Defined results: null texts count as empty; an empty text has one empty passage, so it gets a
score like any other. Null labels are not learned; of several labels of one id the largest
counts. With no labels all scores are 0.5. Repeated rows are scored alike. Only doc_id and text
are read of `docs`; other columns are ignored; an empty table gives no rows. Texts are
processed whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, held_out, table
from .textnum import buffers, chars_are, codes_of

PASSAGE = 512
PAIRS = 48
HIDDEN = 24
ATTEND = 12
#: The bounds of the training sample.
TRAIN_ROWS = 6000
TRAIN_PASSAGES = 256
#: Texts of one id that are learned from.
TEXTS_OF_ID = 4
THRESHOLD = 0.3
_SIGNS = "!|.,?%&*$#-:;\"'()@/=_"
PLAIN = 14
WIDTH = PLAIN + len(_SIGNS) + PAIRS


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and for each text where its passages begin (one more entry at the end)."""
    feats, first = [], [0]
    for lo, hi in buffers(texts, 512):
        lens = np.array([len(t) for t in texts[lo:hi]])
        count = np.maximum(1, -(-lens // PASSAGE))
        start = np.concatenate([[0], np.cumsum(count)])
        grid = np.zeros(start[-1] * PASSAGE, np.uint32)
        codes = codes_of("".join(texts[lo:hi]))
        shift = start[:-1] * PASSAGE - np.concatenate([[0], np.cumsum(lens)[:-1]])
        grid[np.arange(codes.size) + np.repeat(shift, lens)] = codes
        doc = np.repeat(np.arange(hi - lo), count)
        rows = grid.reshape(-1, PASSAGE)
        block = np.concatenate([_features(rows[a : a + 2048]) for a in range(0, len(rows), 2048)])
        block[:, PLAIN - 2 : PLAIN] = _repeats(texts[lo:hi])[doc]
        feats.append(block)
        first += (first[-1] + start[1:]).tolist()
    return (np.concatenate(feats) if feats else np.empty((0, WIDTH), np.float32)), np.array(first)


def _features(x: np.ndarray) -> np.ndarray:
    """x: code points, a passage a row, padded with 0."""
    used = np.maximum((x > 0).sum(axis=1), 1).astype(np.float32)
    out = np.empty((len(x), WIDTH), np.float32)
    flat = x.ravel()
    letter = chars_are("isalpha", flat).reshape(x.shape)
    upper = chars_are("isupper", flat).reshape(x.shape)
    digit = (x >= 48) & (x <= 57)
    space = (x == 32) | (x == 10) | (x == 9) | (x == 13)
    edge = letter.copy()
    edge[:, 1:] &= ~letter[:, :-1]
    words = np.maximum(edge.sum(axis=1), 1)
    share = lambda m: m.sum(axis=1) / used
    out[:, 0] = np.log(used)
    out[:, 1], out[:, 2], out[:, 3], out[:, 4] = share(letter), share(upper), share(digit), share(space)
    out[:, 5] = share(x > 127)
    out[:, 6] = share(x == 10)
    out[:, 7] = letter.sum(axis=1) / words / 10
    out[:, 8] = (edge & upper).sum(axis=1) / words
    out[:, 9] = 1 - out[:, 1] - out[:, 3] - out[:, 4]
    # distinct runs of six characters: low where a passage repeats itself
    h = x.astype(np.uint64)
    h = h[:, :-1] * np.uint64(1000003) + h[:, 1:]
    pair = h
    h = h[:, :-2] * np.uint64(0x9E3779B97F4A7C15) + h[:, 2:]
    h = np.sort(h[:, ::2][:, :254] ^ (h[:, ::2][:, :254] >> np.uint64(31)), axis=1)
    out[:, 10] = (np.diff(h, axis=1) != 0).sum(axis=1) / used
    out[:, 11] = words / used
    for k, c in enumerate(_SIGNS):
        out[:, PLAIN + k] = share(x == ord(c))
    place = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(PAIRS)
    inside = x[:, 1:] > 0
    rows = np.broadcast_to(np.arange(len(x))[:, None], inside.shape)[inside]
    hist = np.bincount(rows * PAIRS + place[inside].astype(np.int64), minlength=len(x) * PAIRS).reshape(-1, PAIRS)
    out[:, PLAIN + len(_SIGNS) :] = hist / used[:, None] * PAIRS
    return out


def _repeats(texts: list[str]) -> np.ndarray:
    """The share of a text's lines, and of its words, that repeat earlier ones."""
    out = np.zeros((len(texts), 2), np.float32)
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x]
        if len(lines) > 1:
            out[i, 0] = 1 - len(set(lines)) / len(lines)
        words = t.split()
        if words:
            out[i, 1] = 1 - len(set(words)) / len(words)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _forward(self.p, (feats - self.mean) / self.scale, first)["y"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    x = np.clip(x, -8, 8)
    h = np.tanh(x @ p["E"] + p["e"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    a = (v * u) @ p["w"]
    n, starts = np.diff(first), first[:-1]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), n))
    a /= np.repeat(np.add.reduceat(a, starts), n)
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "n": n, "y": _sigmoid(z @ p["c"] + p["b"])}


def _gradient(p: dict[str, np.ndarray], f: dict[str, np.ndarray], first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    dy = (f["y"] - label) / len(label)
    dz = dy[:, None] * p["c"]
    dz_all = np.repeat(dz, f["n"], axis=0)
    da = (dz_all * f["h"]).sum(axis=1)
    da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), f["n"]))
    dg = da[:, None] * p["w"]
    dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
    dh = f["a"][:, None] * dz_all + dv @ p["V"].T + du @ p["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    return {"E": f["x"].T @ dpre, "e": dpre.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ da, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}


def learn(bags: list[np.ndarray], labels: np.ndarray, steps: int = 1500, batch: int = 128, rate: float = 3e-3, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    w = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    share = np.clip(labels.mean(), 0.01, 0.99)
    p = {"E": w(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": w(HIDDEN, ATTEND), "U": w(HIDDEN, ATTEND), "w": rng.normal(0, 0.3, ATTEND), "c": np.zeros(HIDDEN), "b": np.array([np.log(share / (1 - share))])}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for r in range(max(20, -(-steps * batch // len(bags)))):
        order = rng.permutation(len(bags))
        for lo in range(0, len(bags), batch):
            own = order[lo : lo + batch]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
            f = _forward(p, np.concatenate([bags[i] for i in own]), first)
            t += 1
            for k, g in _gradient(p, f, first, labels[own]).items():
                g = g + 1e-4 * p[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate / (1 + t / steps) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p)


def _described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats, first = passages([t or "" for t in batch.column("text").to_pylist()])
        bags = [feats[np.unique(np.linspace(a, b - 1, min(b - a, TRAIN_PASSAGES)).astype(int))].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model | None:
    """Learn from labelled rows whose id is not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.select("doc_id").distinct().count()
    if not n:
        return None
    luck = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000
    sample = known.where(luck < most / n).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    # about `most` rows
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id")
    # of an id with many rows, a few: tasks keep no more of it than that
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    chosen = chosen.withColumn("_place", place).where(F.col("_place") <= TEXTS_OF_ID).drop("_place")
    got = chosen.mapInArrow(_described, "doc_id long, label double, bag binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return learn([np.frombuffer(r["bag"], "<f4").reshape(-1, WIDTH) for r in got], np.array([r["label"] for r in got]))


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            score = np.full(len(texts), 0.5)
            for lo, hi in buffers(texts, 512) if model is not None else ():
                score[lo:hi] = model.score(*passages(texts[lo:hi]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
