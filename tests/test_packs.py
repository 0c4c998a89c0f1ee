"""The strict reader: a good pack, and one fixture for each code, made by a single change to it."""

from __future__ import annotations

import copy
import json

import pytest

from ledgerlens.operators.packs import build, read

TEXT = [
    "Apache in brief",
    "The Apache License supports 12 software projects, as many customers know well. It provides new demand of software products in every market we know. GNU improves its software licenses too, they say in public.",
    "Market demand for software grew by 3.5 percent in the last year, as everybody saw.",
]


@pytest.fixture(scope="module")
def good(spark):
    blocks = spark.createDataFrame([(1, k, t) for k, t in enumerate(TEXT)], "doc_id long, block_no int, block string")
    return json.loads(build(blocks, "Apache").first().pack)


def change(pack, *path, to):
    """A deep copy of the pack with one place changed; `to` may be a function of what was there."""
    out = copy.deepcopy(pack)
    at = out
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = to(at.get(path[-1]) if isinstance(at, dict) else at[path[-1]]) if callable(to) else to
    return out


DOC, BLOCK, CARD = ("source_documents", 0), ("source_documents", 0, "blocks", 1), ("cards", 0)
UNIT = ("cards", 0, "evidence_units", 0)
CASES = {
    "schema_version": [(("schema_version",), "argument_pack.v3"), ((*DOC, "schema_version"), "x"), ((*UNIT, "schema_version"), None)],
    "pack_identity": [(("status",), "selector_incomplete"), (("stock_name",), "Other")],
    "source_input_degraded": [(("diagnostics",), {"rejected_source_documents": {"document_hash": ["a"]}})],
    "source_documents": [(("source_documents",), None)],
    "document_shape": [((*DOC, "canonical_text"), None), ((*DOC, "blocks"), None)],
    "document_hash": [((*DOC, "document_hash"), "sha256:0")],
    "block_sequence": [((*DOC, "blocks"), lambda b: b[:-1])],
    "block_ordinal": [((*BLOCK, "block_ordinal"), 5)],
    "block_shape": [((*BLOCK, "start"), None)],
    "block_offset": [((*BLOCK, "start"), lambda n: n + 1), ((*BLOCK, "end"), 10_000)],
    "block_hash": [((*BLOCK, "block_hash"), "sha256:1")],
    "block_kind": [((*BLOCK, "block_kind"), "heading")],
    "boundary_status": [((*DOC, "boundary_status"), "scope_input_degraded")],
    "source_identity": [(("source_documents",), lambda d: d * 2), ((*DOC, "source_id"), "")],
    "card_schema": [((*CARD, "schema_version"), "v1")],
    "forbidden_card_field": [((*CARD, "recommendation"), "buy"), ((*CARD, "score"), "1")],
    "card_scope": [((*CARD, "entity_scope"), "anything"), ((*CARD, "entity_scope"), "target_with_peer_context")],
    "card_target_entity": [((*CARD, "target_entity"), "")],
    "card_family": [((*CARD, "primary_family"), "other"), ((*CARD, "coverage_families"), lambda f: [*f, "valuation_expectation"])],
    "card_units": [((*CARD, "evidence_units"), []), ((*CARD, "evidence_units"), None)],
    "duplicate_unit": [((*CARD, "evidence_units"), lambda u: [u[0], *u]), ((*UNIT, "unit_id"), "")],
    "unit_source": [((*UNIT, "source_id"), "doc:9")],
    "document_reference": [((*UNIT, "block_id"), "block:9"), ((*UNIT, "document_hash"), "sha256:0")],
    "unit_shape": [((*UNIT, "unit_end"), None)],
    "unit_offset": [((*UNIT, "unit_start"), 1), ((*UNIT, "unit_end"), 9_999), (("cards", 1, "evidence_units", 0, "unit_end"), lambda n: n + 1)],
    "unit_hash": [((*UNIT, "unit_hash"), "sha256:0"), ((*UNIT, "block_hash"), "sha256:0")],
    "unit_identity": [((*UNIT, "argument_status"), "kept"), ((*UNIT, "coverage_families"), lambda f: f[:1] + ["demand_customer", "x"]), ((*UNIT, "unit_ordinal"), 7)],
    "scope_provenance": [((*UNIT, "origin"), "explicit_peer")],
    "unit_citations": [((*UNIT, "citation_refs"), []), ((*UNIT, "citation_refs"), ["2"])],
    "citation_identity": [(("citations", "1", "source_document_hash"), "sha256:0"), (("citations", "1", "source_ref"), "x")],
    "card_citations": [((*CARD, "citation_refs"), ["1", "1"]), ((*CARD, "source_identity"), [["a", "b"]])],
    "unused_citations": [(("citations", "2"), {"source_id": "doc:1"})],
}


def codes(spark, packs):
    df = spark.createDataFrame(list(enumerate(packs)), "pack_id long, pack string")
    return {r.pack_id: (r.status, r.code) for r in read(df, "Apache").collect()}


def test_a_good_pack_and_every_code(spark, good):
    assert len(good["cards"]) >= 2 and any(len(c["evidence_units"]) > 1 for c in good["cards"])
    told = [(code, change(good, *path, to=to)) for code, cases in CASES.items() for path, to in cases]
    got = codes(spark, [json.dumps(good), *(json.dumps(p) for _, p in told)])
    assert got[0] == ("ok", "")
    wrong = [(code, got[n]) for n, (code, _) in enumerate(told, 1) if got[n] != ("invalid", code)]
    assert not wrong


def test_corrupt_records_and_packs_without_cards(spark, good):
    bare = {**good, "cards": None, "citations": {}}
    got = codes(spark, ["{", json.dumps(good)[:-1], "[]", None, "", json.dumps({**good, "cards": "x"}), json.dumps(bare), json.dumps({**good, "more": 1})])
    assert {k: v[1] for k, v in got.items() if k < 6} == dict.fromkeys((0, 1, 5), "malformed") | {k: got[k][1] for k in (2, 3, 4)}
    assert all(got[k][0] == "invalid" for k in range(6)) and got[6] == ("ok", "") and got[7] == ("ok", "")
    assert codes(spark, []) == {}


def test_a_pack_is_read_once_and_no_row_carries_its_whole_document(spark, good, monkeypatch):
    """JSON is parsed once, and where blocks are at their places the document's text goes with none of them."""
    from ledgerlens.operators import packs as M

    plans, wrote = [], M.written
    monkeypatch.setattr(M, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or wrote(df))
    df = spark.createDataFrame([(1, json.dumps(good))], "pack_id long, pack string")
    out = read(df, "Apache")
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("from_json") for p in plans) == 1
    assert [(r.status, r.code) for r in out.collect()] == [("ok", "")]


def test_a_block_may_be_stored_at_another_place_that_reads_the_same(spark, good):
    """Offsets that aren't a block's own are searched in the text: the same words elsewhere will do, others won't."""
    line = "Market demand for software grew by 3.5 percent in the last year, as everybody saw."
    blocks = spark.createDataFrame([(1, k, t) for k, t in enumerate([line, "Apache in brief", line])], "doc_id long, block_no int, block string")
    twice = json.loads(build(blocks, "Apache").first().pack)
    last = ("source_documents", 0, "blocks", 2)
    there = change(change(twice, *last, "start", to=0), *last, "end", to=len(line))
    other = change(change(twice, *last, "start", to=1), *last, "end", to=len(line) + 1)
    empty = change(twice, *last, "end", to=twice["source_documents"][0]["blocks"][2]["start"])
    assert codes(spark, [twice, there, other, empty]) == {0: ("ok", ""), 1: ("ok", ""), 2: ("invalid", "block_offset"), 3: ("invalid", "block_offset")}


def test_texts_are_dealt_out_once_and_stored_once(spark, good, monkeypatch):
    """Building needs no shuffle beside the one that deals documents out; scratch holds a document's text in its blocks alone, and marks of blocks without texts."""
    from ledgerlens.operators import packs as M

    frames, wrote = [], M.written
    monkeypatch.setattr(M, "written", lambda df: frames.append(df) or wrote(df))
    blocks = spark.createDataFrame([(d, k, t) for d in range(5) for k, t in enumerate(TEXT)], "doc_id long, block_no int, block string")
    packs = build(blocks.repartition("doc_id"), "Apache")
    plan = packs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan and not frames
    assert [json.loads(r.pack) == good for r in packs.orderBy("doc_id").collect()] == [False, True, False, False, False]

    assert codes(spark, [json.dumps(good)]) == {0: ("ok", "")}
    stored, known = frames[:2]
    assert "canonical_text" not in stored.schema.simpleString() and stored.schema.simpleString().count("text:string") == 2  # of blocks and of units
    assert not {"block", "text"} & set(known.columns) and "text" not in known.schema.simpleString()


def test_marks_of_blocks_give_what_blocks_give(spark):
    """Derived without their texts, blocks are what the stages over whole blocks make of them."""
    from ledgerlens.operators.packs import _light
    from ledgerlens.plans.evidence import BLOCKS
    from ledgerlens.plans.stages import apply

    texts = [TEXT, ["Apache compared to GNU", "1. one", "A long narrative block about the market, which ends with a full stop and is long."], ["a", "Not investment advice", "Apache"], [None, "Apache versus others", ""], ["Versus", "x" * 60]]
    blocks = spark.createDataFrame([(d, k, t) for d, lines in enumerate(texts) for k, t in enumerate(lines)], "doc_id long, block_no int, block string")
    names = ["doc_id", "block_no", "size", "block_start", "kind", "boundary", "target_centric"]
    whole = apply(blocks, BLOCKS.stages).selectExpr("doc_id", "block_no", "length(block) AS size", *names[3:])
    light = _light(blocks.withColumn("d", blocks["doc_id"]), "d").withColumnRenamed("d", "doc_id").select(*names)
    assert sorted(map(tuple, light.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert {r.kind for r in light.collect()} == {"heading", "narrative", "structural_noise"} and light.where("boundary = 'scope_input_degraded'").count() == 6
