"""Exact evidence units of documents and who they are about.

A document's lines are blocks: headings, narrative, and from the first notice that is no content on, noise. Narrative blocks are cut into
sentences with their places; a sentence has families and an admission, and one of seven origins, tried in order:
a relation between the target and a peer, the target, a peer, the sector, the owner of its block (peer, then target) or of
its document, none. Names are matched longest first; the owner of a block is whom its first naming sentence names.
Windows stay within a document; patterns run alike in both engines.
"""

from __future__ import annotations

import re

from ..functions.text import both, match_re, sha256
from .stages import Query, stage
from .texts import DOCS

#: Parameters: names of the target and of its peers, longest first; the defaults suit the given corpus.
TARGET = ("apache software foundation", "apache license", "apache")
PEERS = ("general public license", "creative commons", "mit license", "gnu", "cc by")
#: Families with their words, in order of precedence.
FAMILIES = {
    "financial_quality": ("revenue", "profit", "margin", "cash flow", "umsatz", "gewinn", "bénéfice", "ingresos"),
    "technology_product": ("technolog", "product", "software", "version", "chip", "produkt", "logiciel", "producto"),
    "commercialization": ("mass production", "certif", "released", "shipment", "available", "verfügbar", "disponible"),
    "competitive_landscape": ("compet", "market share", "leading", "wettbewerb", "concurren"),
    "demand_customer": ("customer", "demand", "order", "kunde", "client", "pedido"),
    "capacity_delivery": ("supply chain", "delivery", "capacity", "raw material", "lieferkette", "kapazität", "livraison"),
    "policy_geopolitics": ("licen", "policy", "sanction", "tariff", "lizenz", "sanktion", "arancel"),
    "valuation_expectation": ("valuation", "share price", "market cap", "bewertung", "valorisation"),
}
ARGUMENT = "grow|declin|improv|worsen|lead|reach|account for|support|provide|complet|licen|releas|deliver|launch|acqui|cooperat|wächst|sinkt|augment|baisse|aument"
NOISE = "disclaimer|not investment advice|all rights reserved|click above|read the original|keine anlageberatung|ne constitue pas"
COMPARE = "compared (?:to|with)|versus|\\bvs[.]?\\b|better than|lower than|higher than|outperform|gegenüber|im vergleich|par rapport"
COOPERATE = "(?:together|jointly|partner\\w*|cooperat\\w*|alliance) with|zusammen mit|en partenariat avec|junto con"
SECTOR = "^(?:in [0-9]{4},? )?(?:the |die |der |le |la |el )?(?:global |domestic |overseas )?(?:industry|sector|market|supply|demand|vendors|branche|markt|secteur|marché|mercado)\\b"
PARTNER = "(?:competitor|rival|supplier|partner)s? ([a-z][a-z0-9-]{1,15}) (?:announced|released|launched|delivered|acquired|says|said)"
LEGAL = ("inc", "corp", "ltd", "plc", "gmbh", "ag", "llc")
COMPANY = f"\\b([a-z][a-z0-9-]{{1,15}} (?:{'|'.join(LEGAL)})\\b)"
ACTOR = "^([a-z][a-z0-9-]{1,23}) (?:announced|released|launched|delivered|acquired)\\b"
NO_NAME = ("the", "this", "that", "it", "we", "they", "company", "product", "market", "management", "industry")


def _holds(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def holds(column: str, pattern: str, *guards: str) -> tuple[str, str]:
    """`match_re` for a pattern of alternatives. On Spark plain words are looked for as such, the other alternatives only in texts that
    hold one of `guards` (none: in all), words of which each match has one: a pattern tries all its alternatives at each place of a text."""
    parts = re.split(r"[|](?![^(]*[)])", pattern)
    plain = [p for p in parts if re.fullmatch(r"[\w ]+", p)]
    rest = [p for p in parts if p not in plain]
    checks = [_holds(column, *plain)] if plain else []
    if rest:
        among = match_re(column, "|".join(rest))[0]
        checks.append(f"({_holds(column, *guards)} AND {among})" if guards else among)
    return f"({' OR '.join(checks)})", match_re(column, pattern)[1]


def _within(column: str, expr: tuple[str, str], part: str) -> tuple[str, str]:
    """On Spark the pattern sees only `part` of the column, which holds all that it can match."""
    return expr[0].replace(column, part, 1), expr[1]


_ENDS = "[.!?;。！？；]$"  # before an end of line too, so the last three characters are looked at
_CUT = "block"
for _sign in ".!?;":
    _CUT = f"replace({_CUT}, '{_sign} ', concat('{_sign} ', char(1)))"
#: Sentences end at signs before a blank, or at full-width signs; pieces follow each other without gaps.
_PIECES = (
    f"split(if({_holds('block', '。', '！', '？', '；')}, regexp_replace({_CUT}, '([。！？；]+ ?)', concat('$1', char(1))), {_CUT}), char(1))",
    "string_split(regexp_replace(regexp_replace(block, '([.!?;]) ', '\\1 ' || chr(1), 'g'), '([。！？；]+ ?)', '\\1' || chr(1), 'g'), chr(1))",
)

_LINES = (
    "SELECT doc_id, posexplode(filter(transform(split(coalesce(text, ''), '\\n+'), x -> trim(regexp_replace(x, r'\\s+', ' '))), x -> x <> '')) AS (block_no, block) FROM documents WHERE doc_id IS NOT NULL",
    """SELECT doc_id, unnest(range(len(b))) AS block_no, unnest(b) AS block FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n+'),
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents WHERE doc_id IS NOT NULL) d""",
)
_SO_FAR = "OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND {0})"
_DOCUMENT = "OVER (PARTITION BY doc_id)"


def named(column: str, names: tuple[str, ...]) -> str:
    """The longest of the names that a lower-cased text holds, else NULL."""
    return "CASE " + " ".join(f"WHEN contains({column}, '{n}') THEN '{n}'" for n in sorted(names, key=len, reverse=True)) + " END"


def _families(column: str) -> str:
    return "concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{f}' END" for f, words in FAMILIES.items()) + ")"


def _first(pattern: str, guard: str | None = None) -> tuple[str, str]:
    """What the pattern's group matches first, else NULL; on Spark only texts for which `guard` holds, as it does for all that match, are searched."""
    found = f"nullif(regexp_extract(low, r'{pattern}', 1), '')"
    return f"CASE WHEN {guard} THEN {found} END" if guard else found, f"nullif(regexp_extract(low, '{pattern}', 1), '')"


BLOCKS = Query(
    _LINES,
    (
        stage(low_block="lower(block)"),
        stage(is_noise=both("CAST({0} AS INT)", holds("low_block", NOISE)), short=both("length(block) <= 48 AND NOT {0}", _within("block", match_re("block", _ENDS), "right(block, 3)")), numbered=_within("block", match_re("block", "^[0-9]{1,2}[.)] "), "left(block, 4)")),
        stage(noise=f"max(is_noise) {_SO_FAR.format('CURRENT ROW')} = 1", block_start=f"coalesce(sum(length(block) + 2) {_SO_FAR.format('1 PRECEDING')}, 0)"),
        stage(kind="CASE WHEN noise THEN 'structural_noise' WHEN short OR numbered THEN 'heading' ELSE 'narrative' END"),
        stage(titled=f"kind = 'heading' AND {named('low_block', TARGET)} IS NOT NULL"),
        stage(compares=both("max(CAST(titled AND {0} AS INT)) " + _DOCUMENT + " = 1", match_re("low_block", COMPARE)), narratives=f"sum(CAST(kind = 'narrative' AS INT)) {_DOCUMENT}", opens=f"max(CAST(titled AND block_no = 0 AS INT)) {_DOCUMENT} = 1"),
        stage(boundary="CASE WHEN compares AND narratives <= 1 THEN 'scope_input_degraded' ELSE 'preserved' END", target_centric="opens AND NOT compares"),
    ),
    ("doc_id", "CAST(block_no AS BIGINT) AS block_no", "CAST(block_start AS BIGINT) AS block_start", "block", "kind", "boundary", "target_centric"),
    tables=DOCS,
)
_UNITS = (
    f"SELECT doc_id, block_no, block_start, boundary, target_centric, posexplode({_PIECES[0]}) AS (unit_no, piece) FROM b WHERE kind = 'narrative'",
    f"SELECT doc_id, block_no, block_start, boundary, target_centric, unnest(range(len(p))) AS unit_no, unnest(p) AS piece FROM (SELECT *, {_PIECES[1]} AS p FROM b WHERE kind = 'narrative') x",
)
_BLOCK = "PARTITION BY doc_id, block_no ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND"
_OWNER = ("first_value({0}, true) OVER ({1} UNBOUNDED FOLLOWING)", "first_value({0} IGNORE NULLS) OVER ({1} UNBOUNDED FOLLOWING)")
UNIT_STAGES = (
    stage(before=f"coalesce(sum(length(piece)) OVER ({_BLOCK} 1 PRECEDING), 0)", sentence="trim(piece)"),
    stage(where=match_re("sentence", "[\\p{L}\\p{N}]")),
    stage(start_at="before + length(piece) - length(ltrim(piece))", low="lower(sentence)"),
    stage(end_at="start_at + length(sentence)", families=_families("low")),
    stage(
        status=both(
            "CASE WHEN NOT {0} THEN 'incomplete' WHEN families = '' THEN 'unclassified' WHEN {1} THEN 'admitted' ELSE 'incomplete' END", _within("sentence", match_re("sentence", _ENDS), "right(sentence, 3)"), holds("low", f"{ARGUMENT}|[0-9]")
        )
    ),
)
_RELATED = f"({holds('low', COMPARE, 'compared ', 'vs')[0]} OR {holds('low', COOPERATE, ' with')[0]})", match_re("low", f"{COMPARE}|{COOPERATE}")[1]
SCOPE_STAGES = (
    stage(
        target=named("low", TARGET), partner=_first(PARTNER, _holds("low", "competitor", "rival", "supplier", "partner")), known=named("low", PEERS),
        company=_first(COMPANY, _holds("low", *(f" {w}" for w in LEGAL)) + f" AND low RLIKE r' (?:{'|'.join(LEGAL)})\\b'"), actor=_within("low", _first(ACTOR), "left(low, 40)"),
    ),
    stage(peer="coalesce(partner, known, company, CASE WHEN actor NOT IN (" + ", ".join(f"'{w}'" for w in NO_NAME) + ") THEN actor END)"),
    stage(peer="CASE WHEN peer NOT IN (" + ", ".join(f"'{w}'" for w in TARGET) + ") THEN peer END", related=_RELATED, sector=_within("low", match_re("low", SECTOR), "left(low, 64)")),
    stage(names="CASE WHEN target IS NOT NULL THEN concat('target:', target) WHEN peer IS NOT NULL THEN concat('peer:', peer) END"),
    stage(owner=(_OWNER[0].format("names", _BLOCK), _OWNER[1].format("names", _BLOCK))),
    stage(
        origin="""CASE WHEN peer IS NOT NULL AND related AND (target IS NOT NULL OR owner LIKE 'target:%' OR target_centric) THEN 'target_peer_relation' WHEN target IS NOT NULL THEN 'explicit_target' WHEN peer IS NOT NULL THEN 'explicit_peer'
 WHEN sector THEN 'industry_context' WHEN owner LIKE 'peer:%' THEN 'block_peer' WHEN owner LIKE 'target:%' OR target_centric THEN 'target_document_context' ELSE 'ambiguous' END"""
    ),
    stage(surface="CASE origin WHEN 'target_peer_relation' THEN peer WHEN 'explicit_target' THEN target WHEN 'explicit_peer' THEN peer WHEN 'block_peer' THEN substr(owner, 6) WHEN 'target_document_context' THEN coalesce(CASE WHEN owner LIKE 'target:%' THEN substr(owner, 8) END, '" + TARGET[-1] + "') ELSE '' END"),
)
_KEYS = ("doc_id", "block_no", "CAST(unit_no AS BIGINT) AS unit_no")
UNITS = Query(_UNITS, UNIT_STAGES, (*_KEYS, "CAST(start_at AS BIGINT) AS start_at", "CAST(end_at AS BIGINT) AS end_at", both("{0} AS unit_sha", sha256("sentence")), "families", "status"), tables=DOCS, uses={"b": BLOCKS})
SCOPED = Query(_UNITS, (*UNIT_STAGES, *SCOPE_STAGES), (*_KEYS, "origin", "surface", "status"), tables=DOCS, uses={"b": BLOCKS})

QUERIES = {"q_e02_units": UNITS, "q_e03_scope": SCOPED}
