"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as pipeline

from .op01_winnowing import op1_winnowing
from .op02_license_scan import ORACLE_SQL as LICENSE_SQL
from .op02_license_scan import op2_license_scan
from .op03_sharding import op3_sharding
from .op04_decontamination import op4_decontamination
from .op05_pii import op5_pii
from .op06_language_id import op6_language_id
from .op07_quality import op7_quality
from .op08_mixing import op8_mixing
from .op09_secrets import op9_secrets
from .op10_ngram_join import op10_ngram_jaccard_join
from .op11_hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from .op11_hard_negatives import op11_hard_negatives
from .op12_collision_search import op12_collision_search
from .op13_filter_audit import ORACLE_SQL as AUDIT_SQL
from .op13_filter_audit import op13_filter_audit

QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_license_scan": op2_license_scan,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_secrets": op9_secrets,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collision_search": op12_collision_search,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {"op2_license_scan": LICENSE_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op13_filter_audit": AUDIT_SQL}
if PIPELINE_SQL:
    ORACLE_SQL["pipeline"] = PIPELINE_SQL
