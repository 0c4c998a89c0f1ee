"""Topic clusters: the streamed walk and the similarity join against plain Python over rows in order."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerlens.operators.clusters import MOST, Walk, consolidated, similar_classes

ITEMS = "run string, seq long, source string, quality double, topics array<int>, words array<string>"


def alike(a, b):
    return bool(a) and bool(b) and 40 * len(set(a) & set(b)) >= 11 * (len(set(a)) + len(set(b)))


def brute(items):
    """(leader, members) topic by topic in the order of first appearance, everything in one list."""
    out, seen = [], set()
    items = sorted(items, key=lambda r: r[1])
    order = dict.fromkeys(t for r in items for t in sorted(r[4]))
    for topic in order:
        left = [r for r in items if topic in r[4] and r[1] not in seen]
        for seed in left:
            if seed[1] in seen:
                continue
            cluster = [seed]
            seen.add(seed[1])
            for other in left:
                if other[1] in seen:
                    continue
                if len(cluster) >= MOST:
                    break
                if other[2] != seed[2] or alike(other[5], seed[5]):
                    cluster.append(other)
                    seen.add(other[1])
            out.append((topic, seed[1], tuple(sorted(r[1] for r in cluster))))
    return sorted(out)


def made(rng, n, sources, run="r"):
    words = [f"w{k}" for k in range(12)]
    return [(run, i, rng.choice(sources), rng.randrange(5) / 2, sorted(rng.sample(range(4), rng.choice([1, 1, 2]))), rng.sample(words, rng.randrange(0, 6))) for i in range(n)]


def test_clusters_equal_the_walk_over_whole_lists(spark):
    rng = random.Random(5)
    few, hot = made(rng, 150, ["a", "b", "c"]), made(rng, 150, ["a"] * 9 + ["b"], "hot")
    rows = few + [(r[0], 1000 + r[1], *r[2:]) for r in hot] + [("one", 5000, "a", 0.0, [0], [])]
    rows = rows + [(r[0], 3000 + r[1], *r[2:]) for r in made(rng, 80, ["a"], "alone")]
    got = consolidated(spark.createDataFrame(rows, ITEMS).repartition(5), ["run"]).collect()
    quality = {r[1]: (r[3], r[2]) for r in rows}
    for run in ("r", "hot", "one", "alone"):
        mine = [r for r in rows if r[0] == run]
        want = brute(mine)
        told = sorted((r.topic, r.seed, tuple(sorted([r.best, *(int(x.rsplit(":", 1)[1]) for x in r.others)]))) for r in got if r.run == run)
        assert told == want
    for r in got:
        members = [r.best, *(int(x.rsplit(":", 1)[1]) for x in r.others)]
        assert members == sorted(members, key=lambda s: (-quality[s][0], s)) and r.members == len(members) <= MOST
        assert r.sources == sorted({quality[s][1] for s in members})


def test_similar_classes_equal_all_pairs(spark):
    rng = random.Random(9)
    rows = made(rng, 300, ["a", "b"])
    df = spark.createDataFrame(rows, ITEMS).withColumn("class", F.xxhash64(F.array_sort("words")))
    words = {(r.source, r["class"]): r.words for r in df.collect() if r.words}
    want = {(s, c): {d for (t, d), v in words.items() if t == s and d != c and alike(w, v)} for (s, c), w in words.items()}
    got = {(r.source, r["class"]): set(r.near) for r in similar_classes(df, ["source"]).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_a_hot_source_leaves_one_leader_after_another():
    walk = Walk()
    for seq in range(40):
        walk.add(seq, "hot", seq % 20, [])
    walk.end()
    assert walk.out == [p for k in range(20) for p in ((k, k), (k + 20, k))]  # each leads, and takes the item of its class


def test_no_items(spark):
    assert consolidated(spark.createDataFrame([], ITEMS), ["run"]).count() == 0


def test_no_side_of_the_similarity_join_is_broadcast(spark):
    rows = [("g", k, [f"w{k % 7}", *(f"c{j}" for j in range(30))]) for k in range(40)]
    items = spark.createDataFrame(rows, "g string, class long, words array<string>")
    near = similar_classes(items, ["g"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert near.count() == 40 and near.selectExpr("min(size(near))").first()[0] == 39


def test_the_walk_compares_words_itself(spark, monkeypatch):
    """What a leader takes of its own source is told by words, on the way and among those passed over; no pairs are made beforehand."""
    from ledgerlens.operators import clusters as M

    walk = Walk()
    for seq, kind, words in ((0, 100, [1, 2, 3]), (1, 101, [7, 8, 9]), (2, 102, [1, 2, 4]), (3, 103, [7, 8, 5]), (4, None, [])):
        walk.add(seq, "a", kind, words)
    walk.end()
    assert walk.out == [(0, 0), (2, 0), (1, 1), (3, 1), (4, 4)]
    assert not (walk.waiting or walk.of_class or walk.words or walk.classes)

    rows = made(random.Random(3), 200, ["a"] * 5 + ["b"])
    monkeypatch.setattr(M, "similar_classes", None)
    monkeypatch.setattr(M, "written", None)
    got = consolidated(spark.createDataFrame(rows, ITEMS), ["run"]).collect()
    assert sorted((r.topic, r.seed, tuple(sorted([r.best, *(int(x.rsplit(":", 1)[1]) for x in r.others)]))) for r in got) == brute(rows)
