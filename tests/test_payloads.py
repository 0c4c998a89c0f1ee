"""Answers of services, one by one."""

from __future__ import annotations

import json

from ledgerlens.sources import payloads as pl


def answers(spark, *rows):
    return spark.createDataFrame([(s, 1, p if isinstance(p, str) else json.dumps(p)) for s, p in rows], "symbol string, page long, payload string")


def test_fund_flow(spark):
    good = {"ResultCode": 0, "Result": {"list": [{"showtime": "2026-01-05", "closepx": "10.5", "ratio": "1.25%", "superNetIn": "1,200", "extMainIn": "-3"}, {"showtime": "bad"}]}}
    rows = pl.fund_flow_rows(answers(spark, ("A", good), ("B", {"ResultCode": "1", "Result": {"list": [{"showtime": "2026-01-05"}]}}), ("C", "no json"))).collect()
    assert [(r.symbol, str(r.dt), r.close, r.change_pct, r.super_net, r.main_net, r.small_net) for r in rows] == [("A", "2026-01-05", 10.5, 1.25, 1200.0, -3.0, None)]


def test_broker_reports(spark):
    data = [{"title": f"t{i}", "orgSName": "o", "publishDate": d, "infoCode": c} for i, (d, c) in enumerate([("2026-04-30 00:00:00", "x1"), ("2025-01-01", "x2"), ("soon", "x3"), (None, "x4"), ("2026-03-01", "")])]
    rows = pl.broker_reports(answers(spark, ("A", {"data": data}), ("B", {"data": None})), "2026-05-01").orderBy("rk").collect()
    assert [(r.symbol, r.rk, r.title, r.rating, r.url) for r in rows] == [("A", 1, "t0", "", "report/x1.pdf"), ("A", 2, "t4", "", None)]
    many = [{"title": f"t{i}", "publishDate": "2026-04-30"} for i in range(30)]
    assert pl.broker_reports(answers(spark, ("A", {"data": many})), "2026-05-01").count() == 20


def test_statements_of_whole_years(spark):
    data = [{"REPORT_DATE": "2025-12-31 00:00:00", "OPERATE_INCOME": "10.5", "PARENT_NETPROFIT": "--"}, {"REPORT_DATE": "2025-06-30", "OPERATE_INCOME": "4"}]
    got = pl.statement_rows(answers(spark, ("A", {"result": {"data": data}}), ("B", {"result": None}))).collect()
    assert [(r.symbol, r.report_year, r.metric_key, str(r.value)) for r in got] == [("A", 2025, "revenue", "10.50")]


def test_model_judgments(spark):
    evidence = spark.createDataFrame([(i, "u1", "Sales rose 12.5 to 340 units") for i in range(5)], "doc_id long, ref string, text string")
    titles = [{"title": t, "judgments": []} for t in pl.SECTIONS]
    items = [("Rose 12.5", ["u1"], "HIGH"), ("Rose 13.5", ["u1"], "high"), ("Rose", ["u2"], "high"), ("Rose [1]", ["u1"], "high"), ("see www.x.org", ["u1"], "low"), ("Rose", [], "low"), ("Rose", ["u1"], "sure"), ("", ["u1"], "low"), ("By 3", ["u1"], "medium")]
    full = [dict(t) for t in titles]
    full[2] = {"title": pl.SECTIONS[2], "judgments": [{"judgment": j, "evidence_refs": r, "confidence": c} for j, r, c in items]}
    outputs = [
        (0, "Answer:\n" + json.dumps({"schema_version": pl.SCHEMA_VERSION, "sections": full}) + "\nEnd."),
        (1, "nothing"), (2, json.dumps({"schema_version": "v9", "sections": titles})), (3, json.dumps({"schema_version": pl.SCHEMA_VERSION, "sections": titles[::-1]})),
        (4, json.dumps({"schema_version": pl.SCHEMA_VERSION, "sections": titles})),
    ]
    got = pl.model_judgments(spark.createDataFrame(outputs, "doc_id long, payload string"), evidence).collect()
    mine = [r.verdict for r in sorted((r for r in got if r.doc_id == 0), key=lambda r: r.pos)]
    assert mine == ["admitted", "not_grounded", "unknown_evidence_ref", "citation_marker", "raw_url", "no_evidence_refs", "bad_confidence", "empty", "admitted"]
    assert {(r.doc_id, r.verdict) for r in got if r.doc_id} == {(1, "json_parse_failed"), (2, "schema_version_mismatch"), (3, "sections_mismatch")}
