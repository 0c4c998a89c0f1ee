from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import op12_collision_search as op
from ledgerlens.llm.op12_collision_search import Index, Nearest, lines, nearest, threshold

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute(ids, x, i, k=10):
    d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
    return [(int(ids[j]), float(d[j])) for j in order]


def of_queries(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_threshold_is_a_quantile_of_the_binomial():
    for m, half, recall in ((32, 1.7, 0.95), (64, 1.0, 0.99), (8, 1.7, 0.5)):
        p, c = math.erf(half / math.sqrt(2)), threshold(m, half, recall)
        reach = lambda least: sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(least, m + 1))  # noqa: E731, B023
        assert reach(c) >= recall > reach(c + 1)


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_recall_against_brute_force(spark, monkeypatch, kind):
    """Several segments and blocks; uniform directions are the hardest case, clusters end their searches early."""
    monkeypatch.setattr(op, "SEGMENT", 700)
    monkeypatch.setattr(op, "QUERIES", 25)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 24))
    if kind == "clusters":
        x = rng.standard_normal((40, 24))[rng.integers(40, size=4000)] + 0.05 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = rng.permutation(4000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], EMBEDDINGS).repartition(3)
    got = of_queries(nearest(df, F.col("vec_id") % 50 == 0))
    assert len(got) == 80
    hits, wide = 0, x.astype(float)
    for i in np.flatnonzero(ids % 50 == 0):
        true = brute(ids, wide, i)
        found = got[int(ids[i])]
        hits += len({v for v, _ in true} & {v for v, _ in found})
        exact = {int(v): float(np.sqrt(((wide[j] - wide[i]) ** 2).sum())) for j, v in enumerate(ids)}
        assert len(found) == 10 and all(abs(exact[v] - s) < 1e-12 for v, s in found)
        assert [(s, v) for v, s in found] == sorted((s, v) for v, s in found)
    assert hits >= 0.95 * 800


def test_a_search_that_ends_early_verifies_few():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((5000, 24)), 0.01 * rng.standard_normal((20, 24)) + 3])
    index, seen = Index(np.arange(5020), x, lines(24)), []

    class Counting(Nearest):
        def add(self, ids, distances):
            seen.extend(ids)
            super().add(ids, distances)

    best = Counting(10)
    index.search(5019, x[5019], x[5019] @ lines(24), threshold(), best)
    assert set(best.ids) <= set(range(5000, 5019)) and len(seen) < 500


def test_copies_ties_and_small_tables(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(300)] + [(1000, [0.0, 2.0], 0)]
    df = spark.createDataFrame(rows, EMBEDDINGS).repartition(4)
    got = of_queries(nearest(df, F.col("vec_id").isin(5, 1000)))
    assert got[5] == [(i, 0.0) for i in range(11) if i != 5]
    assert got[1000] == [(i, math.sqrt(5)) for i in range(10)]
    few = of_queries(nearest(df.where("vec_id in (1, 2, 1000)"), F.col("vec_id") == 1000))
    assert few == {1000: [(1, math.sqrt(5)), (2, math.sqrt(5))]}
    assert nearest(df.where("vec_id = 5"), F.col("vec_id") == 5).count() == 0


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 2.0], None), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [0.0, 0.0], 1), (7, [], 1), (8, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumn("query", F.lit("x")).withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 2, 1, 1.0)]  # the query row is there twice, and so is its neighbour
    assert nearest(df.limit(0), F.col("vec_id") == 0).columns == ["query_id", "rank", "vec_id", "score"]
    assert nearest(df, F.lit(False)).count() == 0
