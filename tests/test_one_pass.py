"""Queries that read or search their texts once: results by plain Python, scans by the plan."""

from __future__ import annotations

import hashlib
import re

import pytest

import __spark_entry__ as ledger
from ledgerlens.plans.more import REPORT_RULES

TEXTS = ["A !! b", None, "", "net inflow | | and a password", "unverified\nraised"]


@pytest.fixture
def docs(spark, tmp_path):
    def of(texts):
        rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return of


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_report_rules_read_documents_once(spark, docs):
    got = ledger.queries()["q_l03_report_rules"](spark, docs(TEXTS))
    assert scans(got) == 1
    found = {(r.doc_id, r.code) for r in got.collect()}
    for code in ("ev_na_percent", "shouting", "empty_table_cell", "external_map_unverified_claim_framing", "fundflow_claim_without_fundflow_pack"):
        assert {i for i, c in found if c == code} == {i for i, t in enumerate(TEXTS) if re.search(REPORT_RULES[code], (t or "").lower())}
    assert {i for i, c in found if c == "over_compressed"} == set(range(len(TEXTS)))


def test_refs_and_cards_score_once(spark, docs):
    text = "Because revenue rose 12 % in 2024, however the price of USD 3.5 million fell. " * 8
    d = docs([text] * 6 + ["short"] + [None] + [f"Wrote to a@b.org about the licence of {k} things" for k in range(4)])
    refs = ledger.queries()["q_a05_snapshot_refs"](spark, d)
    cards = ledger.queries()["q_e09_display_cards"](spark, d)
    for got in (refs, cards):
        assert "text#" not in got._jdf.queryExecution().optimizedPlan().toString()
    seen = {}
    for r in sorted(refs.collect(), key=lambda r: r.seq):
        seen[r.source] = seen.get(r.source, 0) + 1
        assert r.ref == seen[r.source]
    assert seen and cards.count() > 0


def test_snippets_are_searched_in_marked_sentences_only(spark, docs):
    x, y = "x" * 100, "y " * 60
    texts = [None, "", f"{x}@{y}token{x}.{x}password\n{x}", "no mark. " * 50, f"a@b.org the licence, the License; {y}@@@@{x}@", "password\n\n.token. . @", "a long line of a licence " * 30, "same licence here ok.same licence here ok."]
    got = ledger.queries()["q_x27_snippets"](spark, docs(texts))
    assert "split(text" in got._jdf.queryExecution().optimizedPlan().toString()
    whole = re.compile(r"[^.\n]{0,80}(?:[Ll]icen[cs]e|password|token|@)[^.\n]{0,80}")
    want = [(i, len(s.strip(" ")), hashlib.sha256(s.strip(" ").encode()).hexdigest()) for i, t in enumerate(texts) for s in dict.fromkeys(whole.findall(t or "")) if len(s.strip(" ")) >= 16]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 8
