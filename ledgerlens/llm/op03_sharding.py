"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of equal cells. Virtual nodes of every shard stand at hashed
cells; a key falls into the cell of its hash and belongs to the first virtual node at or
after it (clockwise). No shard may take more than its capacity. Home keys come first, in
ring order; the keys that overflow a full shard continue clockwise to the next virtual
node whose shard has room. With ``slack = 0`` the capacities add up to the number of rows,
so row counts of any two shards differ by at most one; with a slack above 0 fewer rows move
when a shard is added.

Only counts per cell reach the driver (`cells` rows, a parameter, whatever the input), where
the overflow is planned; it comes back as at most cells + shards segments, each giving a run
of ranks within a cell one shard. Rows carry no text through the shuffle.

Defined results: a null text has size 16 and crc32 0 (of no bytes); null ids share one cell;
repeated rows are kept and ranked by id, crc32 and size; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

CELL_BITS = 13
SHARDS = 40
VNODES = 64


def _cell_of(hash64: Column) -> Column:
    return F.shiftrightunsigned(hash64, 64 - CELL_BITS).cast("int")


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; a cell is the place of one node at most."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at, salt = None, 0
            while at is None or at in taken:
                digest = hashlib.sha256(f"shard {s} node {v} try {salt}".encode()).digest()
                at, salt = int.from_bytes(digest[:8], "big") >> (64 - CELL_BITS), salt + 1
            taken[at] = s
    return sorted(taken.items())


def plan_segments(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[dict]:
    """Segments {cell, lo, hi, shard, base}: ranks lo <= r < hi of a cell go to `shard`, to slots base + r - lo."""
    nodes = ring(shards, vnodes)
    places = [c for c, _ in nodes]
    total = sum(counts.values())
    if slack > 0:
        room = [int(-(-total * (1 + slack) // shards))] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    segments, over = [], []

    def give(cell: int, lo: int, hi: int, shard: int) -> int:
        take = min(hi - lo, room[shard])
        if take:
            segments.append({"cell": cell, "lo": lo, "hi": lo + take, "shard": shard, "base": filled[shard]})
            room[shard] -= take
            filled[shard] += take
        return lo + take

    for cell in sorted(counts):
        at = bisect_left(places, cell) % len(nodes)
        rest = give(cell, 0, counts[cell], nodes[at][1])
        if rest < counts[cell]:
            over.append((cell, rest, at))
    for cell, lo, at in over:
        while lo < counts[cell]:
            at = (at + 1) % len(nodes)
            lo = give(cell, lo, counts[cell], nodes[at][1])
    return segments


def shard_documents(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs`."""
    spark = docs.sparkSession
    hashed = F.xxhash64(F.col("doc_id"))
    counts = docs.select(_cell_of(hashed).alias("cell")).groupBy("cell").count().collect()
    segments = plan_segments({r["cell"]: r["count"] for r in counts}, shards, vnodes, slack)
    schema = "array<struct<cell:int,lo:bigint,hi:bigint,shard:int,base:bigint>>"
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(segments)), schema)))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), hashed.alias("_hash"))
    rows = rows.withColumn("cell", _cell_of(F.col("_hash")))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("_hash", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    ranked = rows.withColumn("_rank", (rank - 1).cast("long"))
    # `plan` has at most 2^CELL_BITS + shards rows
    placed = ranked.join(F.broadcast(plan), "cell").where("_rank >= lo AND _rank < hi")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("_rank") - F.col("lo")).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
