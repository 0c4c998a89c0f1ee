"""Packs of argument cards as nested JSON, and the strict reader of them.

A pack holds its source document, block by block, the cards with their exact evidence units, and citations. The reader trusts nothing
that it can derive again: blocks, units, families and origins are computed from the stored text by the same
stages that made them, and compared. Any violation refuses the whole pack with the code of the first one, in reading order;
JSON that doesn't fit the schema goes through the corrupt-record column and refuses its pack too.

Checks are rows (pack, place, code) of exploded arrays, so a pack with many units is spread like any other rows, and only places meet.
A pack is parsed once and written to scratch without its document's text, which its blocks hold: where they don't make it up that is told
before any of them. What blocks are is worked out from marks of theirs, without their texts, which go along only for documents with
units; building deals a document's text out once. No row of a block or a unit carries its whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_re
from ..plans.evidence import _PIECES, BLOCKS, COMPARE, FAMILIES, SCOPE_STAGES, TARGET, UNIT_STAGES, _holds, named
from ..plans.stages import apply, pick, stage
from .dedupe import written

PACK, DOCUMENT, CARD, UNIT = "argument_pack.v4", "source_document.v1", "argument_card.v4", "evidence_unit.v2"
SCOPES = ("target", "target_with_peer_context", "peer_or_industry")
_UNIT = (
    "schema_version STRING, unit_id STRING, source_id STRING, document_hash STRING, block_id STRING, block_ordinal INT, unit_ordinal INT, unit_start INT, unit_end INT, text STRING,"
    " unit_hash STRING, block_hash STRING, coverage_families ARRAY<STRING>, argument_status STRING, origin STRING, citation_refs ARRAY<STRING>"
)
#: Fields that no card may have.
FORBIDDEN = ("claim", "source_quote", "topic_family", "incremental_delta", "target_price", "score", "risk_score", "recommendation", "relation")
_CARD = f"schema_version STRING, entity_scope STRING, target_entity STRING, primary_family STRING, coverage_families ARRAY<STRING>, citation_refs ARRAY<STRING>, source_identity ARRAY<ARRAY<STRING>>, evidence_units ARRAY<STRUCT<{_UNIT}>>, " + ", ".join(f"{f} STRING" for f in FORBIDDEN)
_BLOCK = "block_id STRING, block_ordinal INT, block_kind STRING, text STRING, start INT, end INT, block_hash STRING"
_DOCUMENT = f"schema_version STRING, source_id STRING, source_ref STRING, canonical_text STRING, document_hash STRING, boundary_status STRING, blocks ARRAY<STRUCT<{_BLOCK}>>"
SCHEMA = (
    f"schema_version STRING, status STRING, stock_name STRING, source_documents ARRAY<STRUCT<{_DOCUMENT}>>, cards ARRAY<STRUCT<{_CARD}>>, citations MAP<STRING, STRUCT<source_id STRING, source_ref STRING, source_document_hash STRING>>,"
    " diagnostics STRUCT<rejected_source_documents: MAP<STRING, ARRAY<STRING>>>, _corrupt STRING"
)


def _hash(column: str) -> str:
    return f"concat('sha256:', sha2({column}, 256))"


def _first_told(*checks: tuple[str, str]) -> str:
    """(number of the check, code) of the first condition that holds; conditions that are NULL count as held, so nothing missing passes."""
    return "CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN struct({n} AS step, '{code}' AS code)" for n, (code, ok) in enumerate(checks, 1)) + " END"


def _first_of(*checks: tuple[str, str]) -> Column:
    return F.expr(_first_told(*checks))


#: What stages over the blocks of a document ask of a block's text, and marks in its place.
_MARKS = {"size": "length(block)", "titling": f"{named('low_block', TARGET)} IS NOT NULL", "comparing": match_re("low_block", COMPARE)[0]}
_OF_TEXT = 2  # so many stages look at a block alone


def _marked(e: str) -> str:
    for mark, of_text in _MARKS.items():
        e = e.replace(of_text, mark)
    return e


def _light(blocks: DataFrame, *more: str) -> DataFrame:
    """What is derived from blocks (doc_id, block_no, block), with more columns made of each, but without their texts, worked out once."""
    # a heading that compares is asked for among those that name the target
    marks = {**_MARKS, "comparing": f"({_MARKS['titling']}) AND {_MARKS['comparing']}"}
    rows = apply(blocks, BLOCKS.stages[:_OF_TEXT]).selectExpr("doc_id", "block_no", "is_noise", "short", "numbered", *(f"{e} AS {c}" for c, e in marks.items()), *more)
    kept = [c for c in rows.columns if c not in ("doc_id", "is_noise", "short", "numbered", "titling", "comparing")]
    rows = apply(rows, (stage(**{c: _marked(pick(e, True)) for c, e in s.columns.items()}) for s in BLOCKS.stages[_OF_TEXT:]))
    return written(rows.select(*kept, "block_start", "kind", "boundary", "target_centric"))


def _units_of(known: DataFrame, *more: str) -> DataFrame:
    """Units with origins of known blocks: what a pack with these blocks must hold."""
    pieces = known.where("kind = 'narrative'").selectExpr("doc_id", "block_no", "target_centric", *more, f"posexplode({_PIECES[0]}) AS (unit_no, piece)")
    return apply(pieces, (*UNIT_STAGES, *SCOPE_STAGES))


def _ordered_families(column: Column) -> Column:
    return F.filter(F.array(*map(F.lit, FAMILIES)), lambda f: F.array_contains(column, f))


def build(blocks: DataFrame, stock: str) -> DataFrame:
    """(doc_id, pack) of documents as blocks (doc_id, block_no, block): a card for each run of admitted units of a block that follow each
    other with one scope and leading family."""
    known = apply(blocks.withColumn("block_hash", F.expr(_hash("block"))), BLOCKS.stages)
    stored = F.struct(
        F.expr("concat('block:', block_no)").alias("block_id"), F.col("block_no").cast("int").alias("block_ordinal"), F.col("kind").alias("block_kind"), F.col("block").alias("text"),
        F.col("block_start").cast("int").alias("start"), F.expr("CAST(block_start + length(block) AS INT)").alias("end"), "block_hash",
    )
    docs = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_no", stored.alias("b")))).getField("b").alias("blocks"), F.max("boundary").alias("boundary_status"))
    docs = docs.withColumn("canonical_text", F.array_join(F.col("blocks.text"), "\n\n")).withColumn("document_hash", F.expr(_hash("canonical_text")))
    docs = docs.withColumn("source_id", F.concat(F.lit("doc:"), "doc_id")).withColumn("source_ref", F.concat(F.lit("documents/"), "doc_id"))

    # a unit has a family only if its block holds one of the words; other documents are left out before anything is derived
    worded = F.expr(_holds("_low", *(w for words in FAMILIES.values() for w in words)))
    marked = blocks.withColumn("_low", F.lower("block")).withColumn("worded", worded).drop("_low")
    marked = marked.withColumn("any_worded", F.expr("max(worded) OVER (PARTITION BY doc_id)")).where("any_worded").drop("any_worded")
    worded = apply(marked, BLOCKS.stages).where("worded").withColumn("block_hash", F.expr(_hash("block")))
    units = _units_of(worded, "block_hash").where("status = 'admitted' AND origin <> 'ambiguous'")
    scope = "CASE WHEN origin = 'target_peer_relation' THEN 'target_with_peer_context' WHEN origin IN ('explicit_target', 'target_document_context') THEN 'target' ELSE 'peer_or_industry' END"
    units = units.withColumn("scope", F.expr(scope)).withColumn("all_families", F.split("families", ",")).withColumn("family", F.col("all_families")[0])
    run = "PARTITION BY doc_id, block_no ORDER BY unit_no"
    units = units.withColumn("begins", F.expr(f"NOT coalesce(unit_no = lag(unit_no) OVER ({run}) + 1 AND scope = lag(scope) OVER ({run}) AND family = lag(family) OVER ({run}), false)"))
    units = units.withColumn("run", F.expr(f"sum(CAST(begins AS INT)) OVER ({run})"))
    units = units.withColumn("source_id", F.concat(F.lit("doc:"), "doc_id"))
    unit = F.struct(
        F.lit(UNIT).alias("schema_version"), F.expr("concat_ws(':', 'unit', doc_id, block_no, unit_no, right(sha2(sentence, 256), 16))").alias("unit_id"), "source_id", F.lit("").alias("document_hash"), F.expr("concat('block:', block_no)").alias("block_id"),
        F.col("block_no").cast("int").alias("block_ordinal"), F.col("unit_no").cast("int").alias("unit_ordinal"), F.col("start_at").cast("int").alias("unit_start"), F.col("end_at").cast("int").alias("unit_end"), F.col("sentence").alias("text"),
        F.expr(_hash("sentence")).alias("unit_hash"), "block_hash", F.col("all_families").alias("coverage_families"), F.col("status").alias("argument_status"), "origin", F.array(F.lit("1")).alias("citation_refs"),
    )
    runs = units.groupBy("doc_id", "block_no", "run", "scope", "family", "source_id").agg(F.sort_array(F.collect_list(F.struct("unit_no", unit.alias("u")))).getField("u").alias("evidence_units"))
    card = F.struct(
        F.lit(CARD).alias("schema_version"), F.col("scope").alias("entity_scope"), F.when(F.col("scope") == SCOPES[2], "").otherwise(stock).alias("target_entity"), F.col("family").alias("primary_family"),
        _ordered_families(F.flatten(F.col("evidence_units.coverage_families"))).alias("coverage_families"), F.array(F.lit("1")).alias("citation_refs"),
        F.array(F.array(F.concat(F.lit("documents/"), "doc_id"), "source_id")).alias("source_identity"), "evidence_units",
    )
    cards = runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "run", card.alias("c")))).getField("c").alias("cards"))
    whole = docs.join(cards, "doc_id", "left")
    hashed = F.transform("cards", lambda c: c.withField("evidence_units", F.transform(c["evidence_units"], lambda u: u.withField("document_hash", F.col("document_hash")))))
    whole = whole.withColumn("cards", hashed)
    cited = F.create_map(F.lit("1"), F.struct("source_id", "source_ref", F.col("document_hash").alias("source_document_hash")))
    document = F.struct(F.lit(DOCUMENT).alias("schema_version"), "source_id", "source_ref", "canonical_text", "document_hash", "boundary_status", "blocks")
    citations = F.when(F.col("cards").isNotNull(), cited).otherwise(F.map_filter(cited, lambda k, v: F.lit(False)))
    pack = F.struct(F.lit(PACK).alias("schema_version"), F.lit("ready").alias("status"), F.lit(stock).alias("stock_name"), F.array(document).alias("source_documents"), "cards", citations.alias("citations"))
    return whole.select("doc_id", F.to_json(pack).alias("pack"))


def read(packs: DataFrame, stock: str) -> DataFrame:
    """(pack_id, status, code) of `packs` (pack_id, pack): ok, or invalid with the first violation."""
    parsed = F.from_json("pack", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    before = _first_told(("schema_version", f"d.schema_version = '{DOCUMENT}'"), ("document_shape", "d.canonical_text IS NOT NULL AND d.blocks IS NOT NULL"), ("document_hash", f"d.document_hash = {_hash('d.canonical_text')}"), ("block_sequence", "d.canonical_text = array_join(d.blocks.text, '\\n\\n')"))
    documents = f"transform(source_documents, d -> struct({before} AS v, d.source_id AS source_id, d.source_ref AS source_ref, d.document_hash AS document_hash, d.boundary_status AS boundary_status, d.blocks AS blocks))"
    p = packs.select("pack_id", parsed.alias("p")).select("pack_id", "p.*")
    p = written(p.selectExpr("pack_id", "_corrupt IS NULL AS whole", "schema_version", "status", "stock_name", "diagnostics", "cards", "citations", f"CASE WHEN _corrupt IS NULL THEN {documents} END AS documents")).withColumn("stock", F.lit(stock))
    header = p.select("pack_id", _first_of(
        ("malformed", "whole"), ("schema_version", f"schema_version = '{PACK}'"), ("pack_identity", "status = 'ready' AND stock_name = stock"),
        ("source_input_degraded", "coalesce(size(diagnostics.rejected_source_documents), 0) <= 0"), ("source_documents", "documents IS NOT NULL"),
    ).alias("v")).selectExpr("pack_id", "struct(1 AS part, 0 AS n, v.step AS step, 0 AS m, 0 AS inner_step) AS at", "v.code AS code")

    docs = p.select("pack_id", F.posexplode("documents").alias("n", "d")).selectExpr("pack_id", "n", "d.*", "concat_ws('#', pack_id, n) AS doc_id")
    blocks = docs.selectExpr("pack_id", "n", "doc_id", "posexplode(blocks) AS (block_no, b)").selectExpr("pack_id", "n", "doc_id", "block_no", "b.text AS block", "b")
    of_block = ("b.block_ordinal = block_no AS ordinal_ok", "block IS NOT NULL AND b.start IS NOT NULL AND b.end IS NOT NULL AS shape_ok", f"b.block_hash = {_hash('block')} AS hash_ok")
    known = _light(blocks, "pack_id", "n", "b.block_kind AS told_kind", "b.start AS told_start", "b.end AS told_end", *of_block)
    # where all blocks before it are stored well and make up the text, a block at its own place needs no look at the text; otherwise that is told first
    in_place = "told_start = block_start AND told_end = block_start + size AND told_start < told_end"
    searched = written(known.where(f"NOT coalesce({in_place}, false)")).join(docs.select("pack_id", "n", "blocks"), ["pack_id", "n"])
    searched = searched.selectExpr("*", "get(blocks, block_no).text AS block", "array_join(blocks.text, '\\n\\n') AS canonical_text")

    def block_checks(rows: DataFrame, offset: str) -> DataFrame:
        return rows.select("pack_id", "n", "block_no", _first_of(
            ("block_ordinal", "ordinal_ok"), ("block_shape", "shape_ok"), ("block_offset", offset), ("block_hash", "hash_ok"), ("block_kind", "told_kind = kind"),
        ).alias("v")).selectExpr("pack_id", "struct(2 AS part, n AS n, 5 AS step, block_no AS m, v.step AS inner_step) AS at", "v.code AS code")

    at_place = "told_start >= 0 AND told_start < told_end AND told_end <= length(canonical_text) AND substr(canonical_text, told_start + 1, told_end - told_start) = block"
    block_rows = block_checks(known.where(in_place), in_place).union(block_checks(searched, at_place))
    derived = known.groupBy("pack_id", "n").agg(F.max("boundary").alias("boundary"))
    same = F.expr("count(*) OVER (PARTITION BY pack_id, source_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    after = _first_of(("boundary_status", "boundary_status = coalesce(boundary, 'preserved')"), ("scope_input_degraded", "coalesce(boundary, 'preserved') <> 'scope_input_degraded'"), ("source_identity", "source_id <> '' AND times = 1"))
    place = "struct(2 AS part, n AS n, {0} AS step, 0 AS m, 0 AS inner_step) AS at"
    docs_known = docs.select("pack_id", "n", "source_id", "boundary_status").join(derived, ["pack_id", "n"], "left").withColumn("times", same)
    doc_rows = docs.selectExpr("pack_id", place.format("v.step"), "v.code AS code")
    doc_rows = doc_rows.union(docs_known.select("pack_id", "n", after.alias("v")).selectExpr("pack_id", place.format("5 + v.step"), "v.code AS code"))

    cards = p.select("pack_id", "stock", "citations", F.posexplode("cards").alias("k", "c"))
    families = "filter(array({0}), f -> array_contains(flatten(c.evidence_units.coverage_families), f))".format(", ".join(f"'{f}'" for f in FAMILIES))
    refs = "array_distinct(flatten(c.evidence_units.citation_refs))"
    ordinals = "transform(c.evidence_units, (u, i) -> u.unit_ordinal - i)"
    origins = "c.evidence_units.origin"
    scope = f"CASE WHEN forall({origins}, o -> o IN ('explicit_target', 'target_document_context')) THEN 'target' WHEN forall({origins}, o -> o IN ('explicit_target', 'target_document_context', 'target_peer_relation')) THEN 'target_with_peer_context' ELSE 'peer_or_industry' END"
    early = _first_of(
        ("card_schema", f"c.schema_version = '{CARD}'"), ("forbidden_card_field", " AND ".join(f"c.{f} IS NULL" for f in FORBIDDEN)), ("card_scope", f"c.entity_scope IN {SCOPES}"),
        ("card_target_entity", f"c.target_entity = CASE WHEN c.entity_scope = '{SCOPES[2]}' THEN '' ELSE stock END"), ("card_family", "array_contains(c.coverage_families, c.primary_family)"), ("card_units", "size(c.evidence_units) > 0"),
    )
    late = _first_of(
        ("card_units", f"size(array_distinct(c.evidence_units.source_id)) = 1 AND size(array_distinct(c.evidence_units.block_id)) = 1 AND size(array_distinct({ordinals})) = 1"),
        ("card_family", f"c.coverage_families = {families} AND forall(c.evidence_units, u -> get(u.coverage_families, 0) = c.primary_family)"),
        ("card_citations", f"c.citation_refs = {refs} AND c.source_identity = transform({refs}, r -> array(citations[r].source_ref, citations[r].source_id))"), ("card_scope", f"c.entity_scope = {scope}"),
    )
    at_card = "struct(3 AS part, k AS n, {0} AS step, 0 AS m, 0 AS inner_step) AS at"
    card_rows = cards.select("pack_id", "k", early.alias("v")).selectExpr("pack_id", at_card.format("v.step"), "v.code AS code")
    card_rows = card_rows.union(cards.select("pack_id", "k", late.alias("v")).selectExpr("pack_id", at_card.format("10 + v.step"), "v.code AS code"))

    units = cards.selectExpr("pack_id", "citations", "k", "posexplode(c.evidence_units) AS (m, u)").withColumn("times", F.expr("count(*) OVER (PARTITION BY pack_id, u.unit_id ORDER BY k, m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    sources = docs.selectExpr("pack_id AS s_pack", "n", "source_id AS s_id", "source_ref AS s_ref", "document_hash AS s_hash")
    joined = units.join(sources, (F.col("pack_id") == F.col("s_pack")) & (F.col("u.source_id") == F.col("s_id")), "left")
    joined = written(joined)
    # only blocks of documents with units are looked at again, and only blocks with units are cut into units
    held = blocks.join(joined.select("pack_id", "n").distinct(), ["pack_id", "n"], "left_semi")
    picked = written(held.join(known.select("pack_id", "n", "block_no", "kind", "target_centric"), ["pack_id", "n", "block_no"]))
    cut = picked.join(joined.selectExpr("pack_id", "n", "u.block_ordinal AS block_no").distinct(), ["pack_id", "n", "block_no"], "left_semi")
    # of blocks with one id the first
    named = picked.where("b.block_id IS NOT NULL").groupBy("pack_id", "n", F.col("b.block_id").alias("b_id")).agg(F.min_by(F.struct("b.block_ordinal", F.col("block").alias("text"), "b.block_hash"), "block_no").alias("b"))
    named = named.selectExpr("pack_id AS b_pack", "n AS b_n", "b_id", "b")
    joined = joined.join(named, (F.col("pack_id") == F.col("b_pack")) & (F.col("n") == F.col("b_n")) & (F.col("u.block_id") == F.col("b_id")), "left")
    expected = _units_of(cut, "pack_id", "n").selectExpr("pack_id AS e_pack", "n AS e_n", "block_no AS e_block", "unit_no AS e_unit", "struct(start_at, end_at, sentence, split(families, ',') AS families, status) AS e", "origin AS e_origin")
    here = joined.join(expected, (F.col("pack_id") == F.col("e_pack")) & (F.col("n") == F.col("e_n")) & (F.col("u.block_ordinal") == F.col("e_block")) & (F.col("u.unit_ordinal") == F.col("e_unit")), "left")
    identity = "e.start_at = u.unit_start AND e.end_at = u.unit_end AND e.sentence = u.text AND e.families = u.coverage_families AND e.status = u.argument_status AND b.block_ordinal = u.block_ordinal"
    unit_rows = here.select("pack_id", "k", "m", _first_of(
        ("duplicate_unit", "u.unit_id <> '' AND times = 1"), ("unit_source", "s_id IS NOT NULL"), ("schema_version", f"u.schema_version = '{UNIT}'"), ("document_reference", "b IS NOT NULL AND u.document_hash = s_hash"),
        ("unit_shape", "u.text IS NOT NULL AND u.unit_start IS NOT NULL AND u.unit_end IS NOT NULL"), ("unit_offset", "u.unit_start >= 0 AND u.unit_start < u.unit_end AND u.unit_end <= length(b.text) AND substr(b.text, u.unit_start + 1, u.unit_end - u.unit_start) = u.text"),
        ("unit_hash", f"u.unit_hash = {_hash('u.text')} AND u.block_hash = b.block_hash"), ("unit_identity", identity), ("scope_provenance", "u.origin = e_origin"),
        ("unit_citations", "size(u.citation_refs) > 0 AND forall(u.citation_refs, r -> map_contains_key(citations, r))"),
        ("citation_identity", "forall(u.citation_refs, r -> citations[r].source_id = s_id AND citations[r].source_ref = s_ref AND citations[r].source_document_hash = s_hash)"),
    ).alias("v")).selectExpr("pack_id", "struct(3 AS part, k AS n, 7 AS step, m AS m, v.step AS inner_step) AS at", "v.code AS code")

    used = p.select("pack_id", _first_of(("unused_citations", "array_sort(coalesce(map_keys(citations), array())) = array_sort(array_distinct(flatten(flatten(coalesce(transform(cards, c -> c.evidence_units.citation_refs), array())))))")).alias("v"))
    used = used.selectExpr("pack_id", "struct(4 AS part, 0 AS n, v.step AS step, 0 AS m, 0 AS inner_step) AS at", "v.code AS code")

    rows = header
    for more in (doc_rows, block_rows, card_rows, unit_rows, used):
        rows = rows.union(more)
    first = rows.where("code IS NOT NULL").groupBy("pack_id").agg(F.min_by("code", "at").alias("code"))
    return p.select("pack_id").join(first, "pack_id", "left").select("pack_id", F.when(F.col("code").isNull(), "ok").otherwise("invalid").alias("status"), F.coalesce("code", F.lit("")).alias("code"))
