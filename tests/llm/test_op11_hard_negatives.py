from __future__ import annotations

from math import floor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import op11_hard_negatives as op
from ledgerlens.llm.op11_hard_negatives import Block, Windows, hard_negatives, integers, located, products

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
ROWS = "vec_id long, label long, vector array<long>"


def brute(rows, anchors, positives=5, negatives=5):
    """`rows`: (id, label, integers)."""
    out = []
    for a, label, x in rows:
        if a is None or not anchors(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y in rows if i != a and len(y) == len(x))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(-s, i) for s, i, other in scored if other != label and 80 * -ps <= 100 * -s <= 100 * -ps]
            out += [(a, p, r, i, -ps, s) for r, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("bins", "few", "block"), [(64, 64, 4096), (4, 0, 3), (2, 0, 4096)])
def test_equals_brute_force(spark, monkeypatch, bins, few, block):
    """Few bins force many digits, small blocks several passes; ties and repeated vectors abound."""
    for name, value in (("BINS", bins), ("FEW", few), ("ANCHORS", block)):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(3)), rng.integers(-3, 9, 4).tolist()) for i in range(160)]
    rows += [(200 + i, i % 2, [5, 5, 5, 5]) for i in range(60)]  # copies: ties without end
    rows += [(i, 1, [2, 2, 2]) for i in (300, 301, 310)]  # vectors of another length
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert collected(hard_negatives(df, F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_scores_of_64_bits_are_located_and_clipped(spark):
    rows = [(0, 1, [2**31, 1]), (1, 1, [2**31, 0]), (2, 2, [2**31 - 1, 7]), (3, 2, [-(2**31), 0]), (4, 2, [2**30, 0]), (5, 2, [2**62, 2**62])]
    got = collected(hard_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") == 0))
    assert got == [(0, 1, 1, 2, 2**62, 2**62 - 2**31 + 7)]
    assert products(np.array([[2**62, 2**62]]), np.array([[2, 2]])).tolist() == [[2**63 - 1]]


def test_location_keeps_the_kth_score_and_little_more(spark, monkeypatch):
    monkeypatch.setattr(op, "FEW", 0)
    rows = [(i, 2, [i]) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    block = Block(pa.table({"vec_id": [0], "label": [1], "vector": [[1]]}))
    one = lambda low, high: Windows(np.array([0]), np.array([low]), np.array([high]))
    assert located(df, block, one(-5000, 5000), False, 5).low.tolist() == [996]
    assert located(df, block, one(10, 12), False, 5).low.tolist() == [10]  # three rows only
    nothing = located(df, block, one(2000, 3000), False, 5)
    assert nothing.low[0] > nothing.high[0]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (2, [1.0, 0.25], 1), (4, [0.85, 0.5], 2), (6, None, 2), (8, [nan, 1.0], 2), (10, [inf, 1.0], 2), (12, [None, 1.0], 2), (14, [1.0, 0.4], None), (None, [1.0, 0.4], 2), (16, [], 2), (4, [0.85, 0.5], 2)]
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumn("window", F.lit("x")).withColumn("score", F.lit("x"))
    got = collected(hard_negatives(integers(df), F.col("vec_id") == 0))
    clean = [(i, lab, [floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i in (0, 2, 4, 16)]
    assert got == brute(clean, lambda i: i == 0) and [r[3] for r in got] == [4, 4]
    assert hard_negatives(integers(df.limit(0)), F.col("vec_id") == 0).count() == 0
    assert hard_negatives(integers(df), F.col("vec_id") == 2).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negative_and_zero_positive_scores(spark):
    rows = [(0, 1, [1]), (1, 1, [-4]), (2, 1, [0]), (3, 2, [-4]), (4, 2, [-5]), (5, 2, [0])]
    assert collected(hard_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0) == [(0, 2, 1, 5, 0, 0)]
