"""Near cards of a document: the streamed greedy pass against all pairs, ids that several rows share, copies in linear time."""

from __future__ import annotations

import random
import time

from ledgerlens.operators.dedupe import near_gone, near_kept


def all_pairs(units):
    sets = sorted((p, set(t.split(" ")) - {""}) for p, t in units)
    sets = [(p, w) for p, w in sets if len(w) >= 4]
    gone = {}
    for p in sorted({p for p, _ in sets}):
        near = [q for q, a in sets for r, b in sets if r == p and q < p and q not in gone and len(a & b) >= 0.85 * len(a | b)]
        if near:
            gone[p] = min(near)
    return gone


def test_streamed_pass_equals_all_pairs(spark):
    rng, rows, want = random.Random(7), [], set()
    for doc in range(30):
        base = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice((3, 7, 20, 40))) for _ in range(4)]
        units = []
        for pos in range(rng.randrange(1, 30)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice("abcxyz0123456789")
            units.append((pos // (2 if doc % 5 == 0 else 1), "  ".join(words)))  # some places twice, as in rows that share an id
        rows += [(doc, p, t.upper()) for p, t in units]
        want |= {(doc, p, k) for p, k in all_pairs(units).items()}
    rng.shuffle(rows)
    rows += [(None, 0, "a b c d e"), (None, 1, "a b c d e")]
    got = near_kept(spark.createDataFrame(rows, "doc_id long, pos int, sentence string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


def test_copies_cost_a_look_each():
    start = time.process_time()
    gone = near_gone(((p, "one two three four five six seven") for p in range(60_000)), 0.85, 4)
    assert len(gone) == 59_999 and set(gone.values()) == {0} and time.process_time() - start < 30
