"""Rows that add something to the owner's: every outcome, and all pairs in plain Python."""

from __future__ import annotations

import random

from ledgerlens.operators.increments import LEAST, contained, fingerprints, incremental

ROWS = "scope string, id string, body string, families array<string>, anchors array<string>, events long"


def outcomes(df):
    return {(r.scope, r.id): r.outcome for r in df.collect()}


def brute(rows, owners):
    out = {}
    for scope, i, body, families, anchors, events in rows:
        mine = [o for o in owners if o[0] == scope]
        near = [o for o in mine if set(families) & set(o[3]) or set(anchors) & set(o[4])]
        known = 0
        for o in near:
            known |= o[5]
        if body and any(body == o[2] or (len(body) >= LEAST and body in o[2]) for o in mine):
            out[scope, i] = "owner_text_duplicate"
        elif not near:
            out[scope, i] = "new_topic_context"
        elif set(anchors) - {a for o in near for a in o[4]}:
            out[scope, i] = "new_concrete_anchor"
        else:
            out[scope, i] = "new_event_variable" if events & ~known else "owner_theme_without_delta"
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(6)
    base = "".join(rng.choices("abcd", k=4000))
    def body():
        at = rng.randrange(3900)
        return base[at : at + rng.choice([0, 5, 23, 24, 40, 90])]
    row = lambda kind, i: (rng.choice("xy"), f"{kind}{i}", body(), rng.sample(["f1", "f2", "f3"], rng.choice([0, 0, 1, 2])), rng.sample(["a1", "a2", "a3", "a4", "a5", "a6"], rng.choice([0, 0, 0, 1])), rng.choice([0, 1, 2, 4, 3]))
    owners = [row("o", i) for i in range(25)] + [("x", "o0", "", [], [], 0)]
    rows = [row("r", i) for i in range(400)] + [("x", "twice", owners[0][2], [], [], 0), ("x", "twice", owners[0][2], [], [], 0), ("z", "alone", "text", ["f1"], ["a1"], 1)]
    got = outcomes(incremental(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(owners, ROWS)))
    assert got == brute(rows, owners) and len(set(got.values())) == 5


def test_contained_texts_share_every_fingerprint():
    rng = random.Random(1)
    whole = "".join(rng.choices("ab é", k=3000)) + "a" * 200
    for _ in range(300):
        a = rng.randrange(len(whole) - LEAST)
        part = whole[a : a + rng.randrange(LEAST, 120)]
        assert len(part) < LEAST or set(fingerprints(part)) <= set(fingerprints(whole))
    assert fingerprints("short").size == 0 and fingerprints("x" * LEAST).size == 1


def test_empty_and_missing(spark):
    rows = spark.createDataFrame([("x", "1", None, None, None, None), ("x", "2", "", [], [], 0)], ROWS)
    none = spark.createDataFrame([], ROWS)
    assert outcomes(incremental(rows, none)) == {("x", "1"): "new_topic_context", ("x", "2"): "new_topic_context"}
    assert incremental(none, rows).count() == 0 and contained(rows, rows).count() == 0


def test_texts_around_one_common_line_do_not_meet_all_its_owners(spark, monkeypatch):
    """Many texts and many owners that differ in a few characters beside one line: what is cut grows with shapes, not with pairs."""
    from ledgerlens.operators import increments as M

    line = "a common line that stands in every one of the texts, in the middle of it"
    owners = [("x", f"o{k}", f"{k:03d}{line}", [], [], 0) for k in range(200)]
    rows = [("x", f"r{k}", f"{k:02d}{line}" if k < 50 else f"{k}!{line}", [], [], 0) for k in range(100)]
    frames = []
    monkeypatch.setattr(M, "cut", lambda met, *more, real=M.cut: frames.append(met) or real(met, *more))
    got = contained(spark.createDataFrame(rows, ROWS), spark.createDataFrame(owners, ROWS)).collect()
    want = {r[1] for r in rows if any(r[2] in o[2] for o in owners)}
    assert {r.id for r in got} == want and len(want) == 50
    shapes = [sum(len(one.shapes) for one in r.wanted) for r in frames[0].collect()]
    assert len(shapes) <= len(owners) and max(shapes) <= 4  # of a hundred texts


def test_long_and_periodic_texts_inside_owners(spark):
    """Texts of every level, those that repeat one unit among them, and texts that only almost are inside."""
    rng = random.Random(4)
    whole = ["".join(rng.choices("abc é", k=5000)), "ab" * 1500 + "c" + "ab" * 900, "z" * 2000]
    rows = []
    for k in range(300):
        text = rng.choice(whole)
        n = rng.choice([24, 95, 96, 97, 383, 384, 1535, 1536, 1900, rng.randrange(24, 2000)])
        a = rng.randrange(len(text) - n + 1)
        part = text[a : a + n]
        rows.append(("x", f"r{k}", part if k % 2 else part[: n // 2] + rng.choice("abz") + part[n // 2 + 1 :], [], [], 0))
    got = contained(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame([("x", f"o{k}", t, [], [], 0) for k, t in enumerate(whole)], ROWS))
    want = {r[1] for r in rows if any(r[2] in t for t in whole)}
    assert {r.id for r in got.collect()} == want and 150 < len(want) < 300


def test_owners_without_what_is_asked_for_go_no_further(spark):
    """Only owners that may hold a text are stored and shuffled with theirs; every gram that is asked for has its marks."""
    from pyspark.sql import functions as F

    from ledgerlens.operators.increments import asked, kept

    rng = random.Random(8)
    text = lambda: "".join(rng.choices("abcdefgh", k=150))
    owners = [text() for _ in range(300)]
    rows = [t[20:80] for t in owners[:30]] + [t[3:147] for t in owners[30:40]] + [text() for _ in range(200)]
    frame = lambda texts: spark.createDataFrame([("x", k, t) for k, t in enumerate(texts)], "scope string, number long, body string").withColumn("salt", F.xxhash64("scope"))
    near = kept(frame(owners), asked(frame(rows))).collect()
    assert {r.number for r in near} >= set(range(40)) and len(near) < 60 and all(r.grams for r in near)
