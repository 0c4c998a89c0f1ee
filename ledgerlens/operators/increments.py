"""Which rows of outside material add something to the owner's rows.

A row (scope, id, body, families, anchors, events: a bit for each event word) is tried in order: its text is, or is inside, an owner's text; no
owner is comparable (shares a family or an anchor); it has an anchor that no comparable owner has; it has an event word that no comparable
owner has; else it adds nothing.

* Containment: a text of 24 characters or more asks for the least hash of its first grams, longer texts for longer grams, and owners keep the
  least hash of every window of as many, so an owner that holds the text keeps what it asks for. Marks of all that is asked for, 32 MB at
  most, are known to every task, so owners without such a hash go no further. Only how far the gram lies behind the text's start and
  how long the text is (its shape) go to the others; an owner cuts its text there and gives digests, those with the marks of a row's alone,
  which are compared with the row's.
  Texts around one common line have few shapes, however many they are, so no text meets all owners of a line.
* An owner with one of the row's anchors is comparable by that anchor, so an anchor is new exactly if no owner of the scope has it: an
  equality join.
* Event words of comparable owners are OR-ed once for each family and anchor before the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import written

#: Of the shortest texts; those that are four times as long have grams and windows of four times the length, and so on.
GRAM, WINDOW = 16, 8
#: The shortest text that counts as contained.
LEAST = GRAM + WINDOW
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Marks of grams or texts that are asked for, two for each; a bitmap of fixed size, whatever the input.
MARKS = 1 << 28
#: Characters that are hashed at a time, if no single text is longer.
_AT_ONCE = 1 << 20
_KEY = "substr(unhex(sha2(body, 256)), 1, 16)"


def level_of(length: int) -> int:
    """How often the least length must be taken four times to come nearest to a text's length."""
    return ((length // LEAST).bit_length() - 1) // 2


def gram_hashes(codes: np.ndarray, level: int) -> np.ndarray:
    """Hashes of all grams of a level, in order."""
    size = GRAM << 2 * level
    if codes.size < size:
        return np.empty(0, np.uint64)
    steps = np.full(codes.size, _BASE, np.uint64)
    steps[0] = 1
    back = np.full(codes.size - size + 1, _BACK, np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.cumprod(steps))])
    h = (sums[size:] - sums[:-size]) * np.cumprod(back)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` hashes in a row."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: have - width], h[width - have :]) if have < width else h


def _parts(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts, so many characters together."""
    part, size = [], 0
    for n, text in enumerate(texts):
        if part and size + len(text) > _AT_ONCE:
            yield part
            part, size = [], 0
        part.append(n)
        size += len(text)
    if part:
        yield part


def asked_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number, hash, place) of the gram that each text asks for: the least of its first window, at its first place. Texts have `LEAST` characters or more."""
    for part in _parts(texts):
        lengths = np.array([len(texts[n]) for n in part])
        levels = np.array([level_of(n) for n in lengths.tolist()])
        for level in np.unique(levels).tolist():
            mine = np.flatnonzero(levels == level)
            starts = np.concatenate([[0], np.cumsum(lengths[mine])[:-1]])
            h = gram_hashes(_codes("".join(texts[part[n]] for n in mine)), level)
            first = h[starts[:, None] + np.arange((WINDOW << 2 * level) + 1)]
            at = first.argmin(axis=1)
            yield np.array(part)[mine], first[np.arange(mine.size), at], at


def kept_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number, hash) of the least gram of every full window of each text, each once, for all levels that the text is long enough for."""
    for part in _parts(texts):
        lengths = np.array([len(texts[n]) for n in part])
        level = 0
        while (mine := np.flatnonzero(lengths >= LEAST << 2 * level)).size:
            ends = np.cumsum(lengths[mine])
            owner = np.repeat(np.arange(mine.size), lengths[mine])
            least = _least(gram_hashes(_codes("".join(texts[part[n]] for n in mine)), level), (WINDOW << 2 * level) + 1)
            owner = owner[: least.size]
            within = np.arange(least.size) + (LEAST << 2 * level) <= ends[owner]
            least, owner = least[within], owner[within]
            new = np.ones(least.size, bool)
            new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
            least, owner = least[new], owner[new]
            order = np.lexsort((least, owner))
            least, owner = least[order], owner[order]
            new = np.ones(least.size, bool)
            new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
            yield np.array(part)[mine[owner[new]]], least[new]
            level += 1


def fingerprints(text: str) -> np.ndarray:
    """What one text keeps, each once; none for texts without a window."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *(h for _, h in kept_grams([text]))])).view(np.int64)


def _salted(batch: pa.RecordBatch, number: np.ndarray, h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) ^ batch.column("salt").to_numpy()[number]


def asked(texts: DataFrame) -> DataFrame:
    """(gram, shapes: distinct (place, length)) of what `texts` (salt, body) ask for; the salt tells scopes apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            for number, h, at in asked_grams(bodies):
                yield pa.record_batch([pa.array(_salted(batch, number, h)), pa.array(at, pa.int32()), pa.array([len(bodies[n]) for n in number.tolist()], pa.int32())], names=["gram", "place", "length"])

    rows = texts.where(f"length(body) >= {LEAST}").select("salt", "body").mapInArrow(run, "gram long, place int, length int")
    return rows.groupBy("gram").agg(F.collect_set(F.struct("place", "length")).alias("shapes"))


def marks(codes: DataFrame) -> Broadcast:
    """A bitmap with the marks of every `code`."""
    slots = codes.select(F.explode(F.array(F.col("code").bitwiseAND(MARKS - 1), F.shiftrightunsigned("code", 28).bitwiseAND(MARKS - 1))).alias("slot"))
    parts = slots.groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    bits = np.zeros(MARKS // 8, np.uint8)
    for row in parts.collect():  # 8192 of 4 KB at most
        bits[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return codes.sparkSession.sparkContext.broadcast(bits)


def _has_marks(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    first, second = codes & (MARKS - 1), (codes.view(np.uint64) >> np.uint64(28)).view(np.int64) & (MARKS - 1)
    return ((bits[first >> 3] >> (first & 7)) & (bits[second >> 3] >> (second & 7)) & 1).astype(bool)


def kept(texts: DataFrame, asking: DataFrame) -> DataFrame:
    """`texts` (scope, salt, number, body) that keep what has the marks of a gram of `asking`, with `grams`: what they keep of these."""
    known, columns = marks(asking.select(F.col("gram").alias("code"))), ("scope", "salt", "number", "body")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, grams = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for number, h in kept_grams(batch.column("body").to_pylist()):
                gram = _salted(batch, number, h)
                there = _has_marks(known.value, gram)
                numbers.append(number[there])
                grams.append(gram[there])
            number = np.concatenate(numbers)
            order = np.argsort(number, kind="stable")
            number, gram = number[order], np.concatenate(grams)[order]
            first = np.flatnonzero(np.diff(number, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, number.size), pa.int32()), pa.array(gram))
            yield pa.record_batch([*batch.take(pa.array(number[first])).columns, lists], names=[*columns, "grams"])

    return texts.where(f"length(body) >= {LEAST}").select(*columns).mapInArrow(run, "scope string, salt long, number long, body string, grams array<long>")


def cut(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(scope, key) of the pieces of `met` (scope, salt, body, wanted: (gram, shapes)) at their grams, cut to the shapes, that have the marks of one of `texts` (body)."""
    known = marks(texts.where(f"length(body) >= {LEAST}").selectExpr("CAST(conv(left(sha2(body, 256), 14), 16, 10) AS BIGINT) AS code"))

    def pieces(body: str, salt: int, wanted: list[dict]) -> set[bytes]:
        codes, levels, out = _codes(body), {}, set()
        for one in wanted:
            gram = np.uint64((one["gram"] ^ salt) & 0xFFFFFFFFFFFFFFFF)
            for shape in one["shapes"]:
                level, length = level_of(shape["length"]), shape["length"]
                if level not in levels:
                    levels[level] = gram_hashes(codes, level)
                if (level, gram) not in levels:
                    levels[level, gram] = np.flatnonzero(levels[level] == gram)
                for start in (levels[level, gram] - shape["place"]).tolist():
                    if start >= 0 and start + length <= len(body):
                        out.add(hashlib.sha256(body[start : start + length].encode()).digest()[:16])
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("scope", "salt", "body", "wanted")}
                found |= {(row["scope"], key) for key in pieces(row["body"], row["salt"], row["wanted"])}
            there = _has_marks(known.value, np.array([int.from_bytes(key[:7]) for _, key in found], np.int64))
            found = [f for f, t in zip(found, there.tolist(), strict=True) if t]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["scope", "key"])

    return met.select("scope", "salt", "body", "wanted").mapInArrow(run, "scope string, key binary").distinct()


def inside(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """(scope, key) of the bodies of `rows` that are an owner's, or, from `LEAST` characters on, inside one, each once; others may be among them, but none of `rows`."""
    salt = F.xxhash64("scope").alias("salt")
    asking = written(asked(rows.where("scope IS NOT NULL").select(salt, "body")))
    # two texts of one number would only be looked into for each other's grams too
    own = owners.where("scope IS NOT NULL").select("scope", salt, F.xxhash64("scope", "body").alias("number"), "body")
    near = written(kept(own, asking))
    wanted = near.select("number", F.explode("grams").alias("gram")).join(asking, "gram").groupBy("number").agg(F.collect_set(F.struct("gram", "shapes")).alias("wanted"))
    equal = owners.where("body <> '' AND scope IS NOT NULL").select("scope", F.expr(_KEY).alias("key"))
    return equal.union(cut(near.drop("grams").join(wanted, "number"), rows.where("scope IS NOT NULL"))).distinct()


def contained(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """(scope, id) of the rows whose body is an owner's, or, from `LEAST` characters on, inside one."""
    return rows.select("scope", "id", F.expr(_KEY).alias("key")).join(inside(rows, owners), ["scope", "key"], "left_semi").select("scope", "id").distinct()


def incremental(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """(scope, id, outcome) of `rows`: owner_text_duplicate, new_topic_context, new_concrete_anchor, new_event_variable or owner_theme_without_delta."""

    def features(df: DataFrame, column: str) -> DataFrame:
        return df.select("scope", "id", "events", F.explode(column).alias("feature"))

    masks = {c: features(owners, c).groupBy("scope", "feature").agg(F.bit_or("events").alias("mask")) for c in ("families", "anchors")}
    of_families = features(rows, "families").join(F.broadcast(masks["families"]), ["scope", "feature"])  # a row for each scope and family: a fixed list
    anchored = features(rows, "anchors").join(masks["anchors"], ["scope", "feature"], "left")
    met = of_families.select("scope", "id", "mask", F.lit(0).alias("fresh")).union(anchored.select("scope", "id", "mask", F.col("mask").isNull().cast("int")))
    known = met.groupBy("scope", "id").agg(F.bit_or("mask").alias("known"), F.max("fresh").alias("fresh"))
    twice = inside(rows, owners).withColumn("twice", F.lit(True))
    out = rows.select("scope", "id", "events", F.expr(_KEY).alias("key")).join(known, ["scope", "id"], "left")
    outcome = (
        F.when(F.col("known").isNull(), "new_topic_context")
        .when(F.col("fresh") == 1, "new_concrete_anchor")
        .when(F.col("events").bitwiseAND(F.bitwise_not("known")) != 0, "new_event_variable")
        .otherwise("owner_theme_without_delta")
    )
    out = out.select("scope", "id", "key", outcome.alias("else")).join(twice, ["scope", "key"], "left")
    return out.select("scope", "id", F.when(F.col("twice"), "owner_text_duplicate").otherwise(F.col("else")).alias("outcome"))
