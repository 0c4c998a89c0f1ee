"""Blocks, exact units and the seven origins, on texts written for each rule; offsets against the texts themselves."""

from __future__ import annotations

import re

import pytest

from ledgerlens.functions.text import match_re
from ledgerlens.plans import evidence as V
from ledgerlens.plans.evidence import BLOCKS, SCOPED, UNITS
from ledgerlens.plans.stages import apply


@pytest.fixture
def on(spark, tmp_path):
    """Runs a query over documents of the given texts."""

    def run(query, *texts):
        rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return query.run(spark, str(tmp_path)).collect()

    return run


def origins(rows):
    return [(r.origin, r.surface) for r in sorted(rows, key=lambda r: (r.doc_id, r.block_no, r.unit_no))]


FILL = " that is a sentence of some length to make it narrative."


def test_seven_origins(on):
    told = origins(on(SCOPED, "\n".join([
        f"Apache does better than Creative Commons,{FILL}",  # relation, target in the sentence
        f"The Apache Software Foundation leads,{FILL}",
        f"GNU grows,{FILL} It improves,{FILL}",  # a peer, then the owner of its block
        f"Market growth goes on,{FILL}",  # the sector
        f"The Apache License is there,{FILL} Better than GNU it is,{FILL} It improves,{FILL}",  # target, relation by owner, owner
        f"Nothing is named here,{FILL}",
        f"Competitor zylog announced growth,{FILL} Foo gmbh grows,{FILL} Quux released it,{FILL} The released it,{FILL}",
    ])))
    assert told == [
        ("target_peer_relation", "creative commons"), ("explicit_target", "apache software foundation"), ("explicit_peer", "gnu"), ("block_peer", "gnu"), ("industry_context", ""),
        ("explicit_target", "apache license"), ("target_peer_relation", "gnu"), ("target_document_context", "apache license"), ("ambiguous", ""),
        ("explicit_peer", "zylog"), ("explicit_peer", "foo gmbh"), ("explicit_peer", "quux"), ("block_peer", "zylog"),
    ]


def test_a_document_titled_after_the_target_owns_what_nobody_else_does(on):
    assert origins(on(SCOPED, f"Apache in brief\nNothing is named,{FILL}", f"Other title\nNothing is named,{FILL}", f"Apache versus GNU\nNothing is named,{FILL}\nNor here,{FILL}")) == [
        ("target_document_context", "apache"), ("ambiguous", ""), ("ambiguous", ""), ("ambiguous", ""),
    ]


def test_blocks_kinds_noise_and_boundary(on):
    rows = sorted(on(BLOCKS, f"Apache vs. GNU\n\n1. Numbered heading that is longer than forty-eight characters, as it happens.\nA  long\tline,{FILL}\nDisclaimer: none.\nMore text after it,{FILL}", None, " \n "), key=lambda r: r.block_no)
    assert [r.kind for r in rows] == ["heading", "heading", "narrative", "structural_noise", "structural_noise"]
    assert rows[0].boundary == "scope_input_degraded" and not rows[0].target_centric and rows[2].block.startswith("A long line,")
    assert [r.block_start for r in rows][:3] == [0, 16, 16 + len(rows[1].block) + 2]


def test_units_are_exact_pieces(on):
    texts = [f"Version 2.0 of the product grew by 3.5 %.  It was released!? Nothing more;  and an end without a sign,{FILL[:-1]}", f"Kunden 增长。需求强劲！ Umsatz wächst. ... --- .{FILL}", "a.b.c." * 3000 + FILL]
    blocks = {(r.doc_id, r.block_no): r.block for r in on(BLOCKS, *texts)}
    rows = on(UNITS, *texts)
    import hashlib

    for r in rows:
        piece = blocks[r.doc_id, r.block_no][r.start_at : r.end_at]
        assert hashlib.sha256(piece.encode()).hexdigest() == r.unit_sha and piece == piece.strip() and re.search(r"\w", piece)
    first = [(r.families, r.status) for r in sorted(rows, key=lambda r: (r.doc_id, r.unit_no)) if r.doc_id == 0]
    assert first == [("technology_product", "admitted"), ("commercialization", "admitted"), ("", "unclassified"), ("", "incomplete")]


ODD = [
    "vs", "x vs. y", "avs b", "vs_", "compared  to", "compared with", "compared", "versus", "partnered with", "partner  with", "cooperating with", "together with", "together", "zusammen mit", "growth", "7", "", "gegenu\u0308ber", "gegenüber",
    "competitors zylog says so", "rival a says", "competitor ab said", "competitor ab-c9 launched", "partners said", "foo inc", "foo include", "a inc.", "x foo ag", "again", " ag", "foo-bar gmbh\u0301", "zylog-9 announced", "zylog announcedx",
    "a" * 24 + " delivered", "a" * 25 + " delivered", "a" * 24 + " delivered it", "a" * 24 + " delivered\u0301", "in 2024, the overseas industry", "in 2024, the overseas industryx", "in 2024, the domestic vendors of it", "the industry", "an industry",
    "a disclaimer", "ne constitue pas x", "end.", "end.\u2028", "end.\r\n", "end。", "end. ", "end.\n\n", "12. x", "123. x", "1.x", "1) x", "😀.", "。", "a. b! c? d; e", "a.b。c。 d! 。", "a.  b", ". . ;", "；；x",
]


def test_words_are_looked_for_before_patterns_and_tell_the_same(spark):
    """On Spark plain words are no alternatives of a pattern, and guarded or shortened texts match as whole ones do."""
    told = V.holds("low", V.ARGUMENT)[0]
    assert "RLIKE" not in told and "contains(low, 'account for')" in told
    texts = spark.createDataFrame([(t, t, t) for t in [*ODD, None]], "low string, sentence string, block string")
    new = {c: e for st in (*V.UNIT_STAGES, *V.SCOPE_STAGES) for c, e in st.columns.items() if c in ("partner", "company", "actor", "related", "sector")}
    new |= {"argues": V.holds("low", f"{V.ARGUMENT}|[0-9]"), "noisy": V.holds("low", V.NOISE), "ends": V._within("sentence", match_re("sentence", V._ENDS), "right(sentence, 3)"), "numbered": V.BLOCKS.stages[1].columns["numbered"], "pieces": V._PIECES}
    old = {c: V._first(p)[0] for c, p in (("partner", V.PARTNER), ("company", V.COMPANY), ("actor", V.ACTOR))}
    old |= {c: match_re(x, p)[0] for c, x, p in (("related", "low", f"{V.COMPARE}|{V.COOPERATE}"), ("sector", "low", V.SECTOR), ("argues", "low", f"{V.ARGUMENT}|[0-9]"), ("noisy", "low", V.NOISE), ("ends", "sentence", "[.!?;。！？；]$"), ("numbered", "block", "^[0-9]{1,2}[.)] "))}
    old["pieces"] = "split(regexp_replace(regexp_replace(block, '([.!?;]) ', concat('$1 ', char(1))), '([。！？；]+ ?)', concat('$1', char(1))), char(1))"
    got, want = (apply(texts, [V.stage(**x)]).select("low", *sorted(x)).collect() for x in (new, old))
    assert got == want
    assert all(any(r[c] for r in want) for c in new)
