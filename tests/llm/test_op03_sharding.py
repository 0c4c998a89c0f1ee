from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import op03_sharding as M


def test_counts_differ_by_one_and_slots_have_no_gaps(make):
    texts = [f"text {i}" * (i % 9) for i in range(1003)]
    got = M.shard_documents(make(texts)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1003))
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_partitioning_does_not_matter(make):
    texts = [str(i) for i in range(300)]
    a = {tuple(r) for r in M.shard_documents(make(texts, partitions=1)).collect()}
    assert a == {tuple(r) for r in M.shard_documents(make(texts, partitions=7)).collect()}


def test_one_more_shard_moves_few(make):
    texts = [str(i) for i in range(4000)]
    for slack, most in ((0.0, 0.25), (0.25, 0.08)):
        a = {r.doc_id: r.shard for r in M.shard_documents(make(texts), slack=slack).collect()}
        b = {r.doc_id: r.shard for r in M.shard_documents(make(texts), shards=41, slack=slack).collect()}
        assert sum(a[i] != b[i] for i in a) / len(a) < most
        room = -(-len(texts) * (1 + slack) // 40)
        assert max(Counter(a.values()).values()) <= room


def test_overflow_goes_clockwise():
    nodes = M.ring(3, 4)
    cell = nodes[0][0]
    parts = M.plan_segments({cell: 9}, 3, 4)
    assert [p["hi"] - p["lo"] for p in parts] == [3, 3, 3]
    order, seen = [s for _, s in nodes], []
    for s in order:
        if s not in seen:
            seen.append(s)
    assert [p["shard"] for p in parts] == seen


def walked(keys, shards, vnodes, slack):
    """Keys dealt one by one: home keys first, in ring order, then the overflow clockwise."""
    nodes = M.ring(shards, vnodes)
    total = len(keys)
    room = [-(-total * (1 + slack) // shards)] * shards if slack else [total // shards + (s < total % shards) for s in range(shards)]
    out, waiting = {}, []
    for cell, key in sorted(keys):
        at = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        if room[nodes[at][1]] >= 1:
            room[nodes[at][1]] -= 1
            out[key] = nodes[at][1]
        else:
            waiting.append((cell, key, at))
    for _, key, at in waiting:
        while room[nodes[at][1]] < 1:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        out[key] = nodes[at][1]
    return out


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_against_dealing_one_by_one(make, slack):
    df = make([f"text {i}" for i in range(700)])
    got = {r.doc_id: r.shard for r in M.shard_documents(df, 7, 8, slack).collect()}
    hashed = df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()
    cells = [((((r.h % 2**64) >> (64 - M.CELL_BITS)), (r.h, r.doc_id))) for r in hashed]
    want = walked(cells, 7, 8, slack)
    assert got == {key[1]: s for key, s in want.items()}


def test_odd_and_empty(odd, empty):
    got = M.shard_documents(odd).collect()
    assert len(got) == 8 and Counter(r.size for r in got)[16] == 2
    assert M.shard_documents(empty).count() == 0
