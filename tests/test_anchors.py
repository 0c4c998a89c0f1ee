"""Facts against the amounts of filings: the band join by brute force, blocks in order, rounding and reasons."""

from __future__ import annotations

import random

from ledgerlens.operators.anchors import amounts_of, anchored, band_join, blocks_of, text_amounts
from ledgerlens.operators.filings import CHINESE, ENGLISH

FACTS = "doc_id string, metric string, value long, tolerance long, digits string"
LABELS = {"revenue": "Revenue", "profit": "Net profit"}
TEXT = """Principal operations by product
| Item | Revenue | Cost |
Consolidated statement of income
Unit: USD thousand
Revenue 5 1,234.56 1,100.00
Net profit 6 (12.30) 7
Discussion and analysis
Revenue was 1.23 million, up 12 % on 2024."""


def test_band_join_equals_brute_force(spark):
    rng = random.Random(4)
    facts = [(rng.choice("ab"), i, rng.randrange(-10**12, 10**12), 5 * 10 ** rng.randrange(0, 11)) for i in range(300)]
    facts += [("a", 1000, 7, 0), ("a", 1001, -5, 5), ("b", 1002, 2**52, 5 * 10**12)]
    near = lambda v, t: v + rng.choice([-t - 1, -t, -t // 3, 0, t, t + 1])
    amounts = [(g, k, near(v, t)) for k, (g, _, v, t) in enumerate(facts * 3)] + [("a", -1, 0), ("a", -2, -10)]
    got = band_join(spark.createDataFrame(facts, "g string, i int, value long, tolerance long"), spark.createDataFrame(amounts, "g string, k int, amount long"), ["g"])
    want = sorted((i, k) for g, i, v, t in facts for h, k, a in amounts if g == h and abs(v - a) <= t)
    assert sorted((r.i, r.k) for r in got.collect()) == want


def test_blocks_and_amounts():
    assert [(n, part) for n, part, _ in blocks_of(TEXT, ENGLISH)] == [(1, "segment"), (2, "statement"), (3, "end")]
    got = [(n, part, metric, amount) for n, part, metric, amount, *_ in amounts_of(TEXT, ENGLISH, LABELS)]
    assert got == [
        (1, "segment", "revenue", None),  # a row without a number
        (2, "statement", "revenue", 12_345_600_000), (2, "statement", "revenue", 11_000_000_000),
        (2, "statement", "profit", -123_000_000),  # 6 and 7 are taken for notes
        (3, "end", "revenue", 12_300_000_000),
    ]
    assert [a[3] for a in amounts_of("合并利润表\n单位：万元\n净利润 1,000.5 亿元", CHINESE, {"profit": "净利润"})] == [int(1000.5 * 10**8 * 10**4)]


def test_first_block_within_the_rounding_of_the_cell(spark):
    filings = spark.createDataFrame([("x", "en", TEXT), ("y", "en", None), ("z", "zz", "")], "doc_id string, lang string, text string")
    amounts = text_amounts(filings, {"en": LABELS})
    facts = [
        ("x", "revenue", 12_300_000_000, 50_000_000, ""),  # 1.23 million, from 1234.56 thousand
        ("x", "profit", -123_100_000, 50_000, ""),  # twelve thousand three hundred and ten is too far
        ("x", "cash", 1, 10, ""), ("y", "revenue", 1, 10, ""),
    ]
    got = {(r.doc_id, r.metric): (r.status, r.part, r.amount) for r in anchored(spark.createDataFrame(facts, FACTS), amounts).collect()}
    assert got == {("x", "revenue"): ("anchored", "statement", 12_345_600_000), ("x", "profit"): ("no_amount", None, None), ("x", "cash"): ("no_label", None, None), ("y", "revenue"): ("no_label", None, None)}
    digits = spark.createDataFrame([("x", "profit", 0, 0, "1230"), ("x", "revenue", 0, 0, "123")], FACTS)  # the printed digits, whatever their unit
    assert {(r.metric, r.status, r.part) for r in anchored(digits, amounts).collect()} == {("profit", "anchored", "statement"), ("revenue", "anchored", "end")}
    assert anchored(spark.createDataFrame([], FACTS), amounts).count() == 0
