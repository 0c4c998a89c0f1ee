"""Packs built from documents, damaged in ways that depend on their text, and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packs import build, read
from .evidence import BLOCKS, SCOPED, _LINES
from .stages import _named

STOCK = "Apache"
#: What happens on the way to a pack whose document's hash begins with a digit: pattern, replacement, and the code that must be told.
DAMAGE = {
    "0": ("(?s)^(.*).$", "$1", "malformed"),
    "1": ('"status":"ready"', '"status":"draft"', "pack_identity"),
    "2": ('"document_hash":"sha256:', '"document_hash":"sha256:0', "document_hash"),
    "3": ('"target_entity":"', '"target_entity":"other ', "card_target_entity"),
    "4": ('"block_kind":"narrative"', '"block_kind":"heading"', "block_kind"),
    "5": ('"unit_end":([0-9]+)', '"unit_end":1$1', "unit_offset"),
    "6": ('"argument_status":"admitted"', '"argument_status":"kept"', "unit_identity"),
    "7": ('"origin":"[a-z_]+"', '"origin":"elsewhere"', "scope_provenance"),
    "8": ('"citations":[{]"1"', '"citations":{"9":{"source_id":"x"},"1"', "unused_citations"),
    "9": ('"entity_scope"', '"score":"1","entity_scope"', "forbidden_card_field"),
}


def q_e06_pack_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt out once, before it becomes blocks: all that is derived of a document stays with it
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id")
    blocks = spark.sql(_named(_LINES[0], {"documents": docs}), documents=docs)
    packs = build(blocks, STOCK)
    packs = packs.withColumn("digit", F.regexp_extract("pack", '"document_hash":"sha256:(.)', 1))
    sent = F.col("pack")
    for d, (pattern, by, _) in DAMAGE.items():
        sent = F.when(F.col("digit") == d, F.regexp_replace("pack", pattern, by)).otherwise(sent)
    return read(packs.select(F.col("doc_id").alias("pack_id"), sent.alias("pack")), STOCK)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"q_e06_pack_errors": q_e06_pack_errors}
_CARDLESS = ("3", "5", "6", "7", "8", "9")
ORACLE_SQL = {
    "q_e06_pack_errors": f"""WITH b AS ({BLOCKS.to_sql()}), d AS (SELECT doc_id, substr(sha256(string_agg(block, chr(10) || chr(10) ORDER BY block_no)), 1, 1) AS digit, max(boundary) AS boundary, bool_or(kind = 'narrative') AS narrative FROM b GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id FROM ({SCOPED.to_sql()}) s WHERE status = 'admitted' AND origin <> 'ambiguous'),
v AS (SELECT d.doc_id AS pack_id, CASE WHEN digit = '0' THEN 'malformed' WHEN digit = '1' THEN 'pack_identity' WHEN digit = '2' THEN 'document_hash' WHEN digit = '4' AND narrative THEN 'block_kind' WHEN boundary = 'scope_input_degraded' THEN boundary
  WHEN c.doc_id IS NULL THEN '' {' '.join(f"WHEN digit = '{k}' THEN '{DAMAGE[k][2]}'" for k in _CARDLESS)} ELSE '' END AS code FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
SELECT pack_id, CASE WHEN code = '' THEN 'ok' ELSE 'invalid' END AS status, code FROM v"""
}
