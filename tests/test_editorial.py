"""Snippets around markers, and the budgets of a stock's rows."""

from __future__ import annotations

import pytest

from ledgerlens.plans.editorial import BUDGETS, CHOICE, EVIDENCE, KEPT


@pytest.fixture
def on(spark, tmp_path):
    def run(query, rows):
        spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return query.run(spark, str(tmp_path)).collect()

    return run


def test_snippets_are_bounded_and_need_context(on):
    far, behind = "x" * 100, "y" * 300
    rows = on(EVIDENCE, [
        (1, f"{far} before it our clients in the module business {behind}. Other sentence; unrelated", "a"),
        (2, "They are our customers and partners. Customers means us, means you.", "a"),
        (3, "Nobody released anything here today", "a"),  # no product word, no technical name
        (4, "It was released with ZT9H-12K today. Mass production 1.5 2.5 3.5 of chips.", "a"),  # a technical name; table debris
        (5, None, "a"), (None, "Our customers and partners", "a"),
    ])
    got = {(r.doc_id, r.bucket): r.snippet for r in rows}
    window = got[1, "customer_chain"]
    at = window.index("clients")
    assert at == 60 and len(window) == at + len("clients") + 180 and {k for k in got if k[0] == 1} == {(1, "customer_chain")}
    assert got[2, "customer_chain"] == "They are our customers and partners"
    assert {k for k in got if k[0] in (3, 4, 5, None)} == {(4, "product_lines"), (4, "project_statuses")}


def test_the_best_five_of_a_bucket_once_each(on):
    text = ". ".join([f"Software product number {i} was released" for i in range(9)] + ["Software product number 1 was released"] * 3 + ["The software platform module chip was certified and released as version 2 for customers"])
    got = sorted((r.place, r.snippet) for r in on(EVIDENCE, [(1, text, "a")]) if r.bucket == "product_lines")
    assert len(got) == KEPT and got[0][1].startswith("The software platform") and len({s for _, s in got}) == KEPT


def rows_of(*sentences):
    return [(i, s, "stock") for i, s in enumerate(sentences)]


def test_portrait_and_budgets(on):
    many = [f"Order number {i} was delivered to the station." for i in range(10)]
    got = on(CHOICE, rows_of("The company makes software for customers in the market of licensed application business.", *many))
    portraits = [r for r in got if r.slot == "portrait"]
    assert len(portraits) == 1 and portraits[0].doc_id == 0
    assert sum(r.role == "operating_progress" and r.slot == "row" for r in got) == BUDGETS["operating_progress"]
    assert all(r.place <= BUDGETS[r.role] for r in got)


def test_financial_rows_in_three_steps(on):
    sentences = [
        "Revenue was 120 units in the year in total.", "Net profit was 30 units in the year in total.",  # two core facts: one overview
        "The costs had a growth of 12 % against the year before.",  # performance and quality
        "Prices were lower because demand was weak over there.",  # driver
        "Other costs were there as in all of the years.", "Further costs were there as in all of the years.", "Still more costs were there as in all years.", "And some more costs were there as in all years.",
    ]
    got = {(r.slot, r.doc_id): r.place for r in on(CHOICE, rows_of(*sentences)) if r.role == "financial_quality_explanation"}
    assert {k: v for k, v in got.items() if k[0] == "overview"} == {("overview", 0): 1, ("overview", 1): 1}
    assert got["performance", 2] == 2 and len(got) - 1 <= BUDGETS["financial_quality_explanation"]
    assert sorted(v for v in got.values()) == [1, 1, 2, 3, 4, 5, 6]
    alone = on(CHOICE, rows_of(sentences[0], sentences[4]))  # one core fact doesn't merge
    assert not any(r.slot == "overview" for r in alone) and len(alone) == 2


def test_no_rows(on):
    assert on(CHOICE, [(1, None, "a"), (2, "short", None)]) == [] and on(EVIDENCE, [(1, "", "a")]) == []
