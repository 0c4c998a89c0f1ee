from __future__ import annotations

import random

from ledgerlens.llm import op04_decontamination as M


def distance(item, text):
    """The least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 150)))
        if rng.random() < 0.5:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + item[: len(item) // 2] + "x" + item[len(item) // 2 :] + text[at:]
        d = distance(item, text)
        got = M.myers(item, text, len(item))
        assert got is None and not text or got is None or got[0] == min(d, got[0]) == d or d == len(item)
        assert M.myers(item, text, d - 1) is None if d else True


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def edit(rng, t, n):
    t = list(t)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], ["z"], [t[i], "q"]])
    return "".join(t)


def test_search_equals_brute_force(spark, make):
    rng = random.Random(2)
    items = [words(rng, rng.randrange(6, 40)) for _ in range(12)]
    texts = []
    for i in range(60):
        t = words(rng, 30)
        if i % 2:
            item = rng.choice(items)
            t = t + ". " + edit(rng, item, rng.randrange(0, M.budget(len(item)) + 4)) + " " + words(rng, 10)
        texts.append(t.title() if i % 3 else t)
    got = {(r.doc_id, r.item_id): r.edits for r in M.contaminated(make(texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            a, b = M.normalise(item), M.normalise(t)
            d = distance(a, b)
            if d <= M.budget(len(a)):
                want[i, k] = d
    assert got == want and want


def test_blocks_and_drop(spark, make, monkeypatch):
    rng = random.Random(3)
    items = [words(rng, 20) for _ in range(8)]
    texts = [words(rng, 20) + " " + items[i] if i < 8 else words(rng, 30) for i in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(M, "BLOCK", 200)
    assert {(r.doc_id, r.item_id) for r in M.contaminated(make(texts), bench).collect()} == {(i, i) for i in range(8)}
    kept = M.drop_contaminated(make(texts), bench)
    assert kept.columns == make(texts).columns and {r.doc_id for r in kept.collect()} == set(range(8, 20))


def test_short_items_match_exactly_between_word_bounds(spark, make):
    items = ["Oslo", "the sea", "x" * (M.PIECE - 1), "x" * M.PIECE]
    texts = ["It is Oslo.", "Osloer", "in OSLO, by The  Sea", "bathe seats", "oslo", "a" + "x" * (M.PIECE - 1), "x" * (M.PIECE - 1), "y" + "x" * M.PIECE, None, ""]
    got = {(r.doc_id, r.item_id, r.edits) for r in M.contaminated(make(texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            a, b = M.normalise(item), M.normalise(t)
            if (f" {a} " in f" {b} ") if len(a) < M.PIECE else a in b:
                want.add((i, k, 0))
    assert got == want == {(0, 0, 0), (2, 0, 0), (2, 1, 0), (4, 0, 0), (6, 2, 0), (7, 3, 0)}
    kept = M.drop_contaminated(make(texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5, 8, 9}


def test_odd_and_empty(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "the the of and the the of and the the of and")], "item_id long, text string")
    got = M.contaminated(odd, bench).collect()
    assert {r.doc_id for r in got} == {3}
    assert M.contaminated(empty, bench).count() == 0
    assert M.contaminated(odd, bench.where("false")).count() == 0
    assert M.drop_contaminated(odd, bench.where("false")).count() == 8
