"""Duplicates by any shared key, and greedy removal along near pairs."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share (`spark.checkpoint.dir`); sessions on one machine may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{scratch_dir(df.sparkSession)}/ledgerlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_key_groups(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root) of `pairs` (id, key): ids that share a key, directly or over others, have the same root, their least id.

    Each round gives every key the least root of its ids and every id the least root of its keys, so labels
    travel one shared key a round; rounds end when no root changes. Rows with a null key stand alone.
    """
    known = written(pairs.where("key IS NOT NULL").select("id", "key").distinct())
    roots = pairs.select("id", F.col("id").alias("root")).distinct()
    for _ in range(rounds):
        by_key = known.join(roots, "id").groupBy("key").agg(F.min("root").alias("low"))
        lower = known.join(by_key, "key").groupBy("id").agg(F.min("low").alias("low"))
        after = written(roots.join(lower, "id", "left").select("id", F.least("root", "low").alias("root"), (F.col("low") < F.col("root")).alias("moved")))
        roots = after.select("id", "root")
        if after.where("moved").isEmpty():
            return roots
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def greedy_kept(pairs: DataFrame) -> DataFrame:
    """(doc_id, pos, kept_pos) of the cards that go: `pairs` (doc_id, first_pos, pos) are near pairs within a
    document, the better card first. In order, a card goes if it is near one that stays; kept_pos is the
    first such. Only a document's near pairs meet in a task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        gone: dict[int, int] = {}
        for pos, near in sorted(g.groupby("pos")["first_pos"]):
            stays = [p for p in near if p not in gone]
            if stays:
                gone[pos] = min(stays)
        return pd.DataFrame({"doc_id": g["doc_id"].iloc[0], "pos": pd.Series(list(gone), dtype="int64"), "kept_pos": pd.Series(list(gone.values()), dtype="int64")})

    return pairs.select("doc_id", "first_pos", "pos").groupBy("doc_id").applyInPandas(run, "doc_id long, pos long, kept_pos long")


def near_gone(units: Iterable[tuple[int, str]], similarity: float, least: int) -> dict[int, int]:
    """The cards of a document that go, with the first card that stays and is near: `units` (pos, words parted by blanks) by pos.

    Words are ordered from the rarest in the document on; near sets share one of their first n - ceil(similarity n) + 1 words. Only
    cards that stay are looked up, so copies of one sentence cost a look each."""
    sets = [(pos, words) for pos, words in ((pos, set(text.split(" ")) - {""}) for pos, text in units) if len(words) >= least]
    df = Counter(w for _, words in sets for w in words)
    stay: dict[str, list[tuple[int, set[str]]]] = {}
    gone: dict[int, int] = {}
    for pos, here in groupby(sets, key=lambda u: u[0]):
        cards, near = [], []
        for _, words in here:
            first = sorted((w for w in words if df[w] > 1), key=lambda w: (df[w], w))
            alone = len(words) - len(first)  # the words of no other card come first
            first = first[: max(0, len(words) - math.ceil(similarity * len(words) - 1e-9) + 1 - alone)]
            cards.append((words, first))
            near += (p for w in first for p, other in stay.get(w, ()) if (common := len(words & other)) >= similarity * (len(words) + len(other) - common))
        if near:
            gone[pos] = min(near)
            continue
        for words, first in cards:
            for w in first:
                stay.setdefault(w, []).append((pos, words))
    return gone


def near_kept(units: DataFrame, similarity: float = 0.85, least: int = 4) -> DataFrame:
    """(doc_id, pos, kept_pos) of the cards that go: `units` (doc_id, pos, sentence) whose sets of words have that Jaccard similarity with one
    before them that stays. Units are dealt by document once and streamed in order; a task holds one document's."""
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("kept_pos", pa.int64())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "low")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, of in groupby(rows(batches), key=lambda r: r[0]):
            gone = near_gone(((pos, low) for _, pos, low in of), similarity, least)
            if gone:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([doc] * len(gone), list(gone), list(gone.values()))], schema=schema)

    low = units.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.lower("sentence").alias("low"))
    return low.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(run, "doc_id long, pos long, kept_pos long")
