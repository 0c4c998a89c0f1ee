"""Queries over posts, pages and reports: quality gates, credit, dedupe, claims, relevance,
external evidence and report checks (S, Q, D, C, N, E, X, L) and their SQL.

Keyword lists are parameters; the defaults suit the given corpus.
"""

from __future__ import annotations

from ..functions.lexicon import DATA
from ..functions.text import all_re, both, count_re, first_re, host, match_re, replace_re, sha256
from .scoring import RISK, stocks
from .stages import Query, Stage, stage

DOCS, PAGES = ("documents",), ("pages",)
#: Themes of posts: lists of the lexicon.
THEMES = {"growth": "driver", "risk": "risk", "policy": "policy", "finance": "finance"}

POSTS = """SELECT doc_id AS seq, source, lang, substr(text, 1, 60) AS title, text AS content,
  (doc_id * 7) % 100 AS likes, (doc_id * 13) % 40 AS comments, (doc_id * 3) % 20 AS reposts,
  date_add(DATE '2024-01-01', CAST(doc_id % 700 AS INT)) AS published FROM documents"""
POSTS = (POSTS, POSTS.replace("date_add(DATE '2024-01-01', CAST(doc_id % 700 AS INT))", "DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER)"))

FLAGS: tuple[Stage, ...] = (
    stage(both_texts="concat(coalesce(title, ''), ' ', coalesce(content, ''))"),
    stage(
        n="length(content)",
        interaction="likes + comments + reposts",
        data_kinds=both("(CAST({0} AS INT) + CAST({1} AS INT) + CAST({2} AS INT) + CAST({3} AS INT))", *(match_re("both_texts", p) for p in DATA)),
        logic_words="terms(both_texts, logic)",
        title_words="terms(title, title)",
        key_words="terms(both_texts, signal)",
    ),
)
GATE: tuple[Stage, ...] = (
    *FLAGS,
    stage(gate="CASE WHEN n >= 200 AND data_kinds > 0 AND logic_words > 0 THEN 'long_data_logic' WHEN n >= 100 AND interaction >= 15 THEN 'interaction' WHEN title_words > 0 AND n >= 80 THEN 'title_keyword' WHEN n < 80 THEN 'too_short' WHEN data_kinds = 0 AND logic_words = 0 THEN 'no_data_no_logic' WHEN interaction < 3 THEN 'no_interaction' ELSE 'below_bar' END"),
    stage(admitted="gate IN ('long_data_logic', 'interaction', 'title_keyword')"),
)
SCORE: tuple[Stage, ...] = (
    *GATE,
    stage(quality="CAST(least(30, data_kinds * 5) + least(25, logic_words * 3) + least(20.0, n / 20.0) + CASE WHEN interaction > 50 THEN 15 WHEN interaction > 20 THEN 10 WHEN interaction > 5 THEN 5 ELSE 0 END + least(10, key_words * 2) AS DOUBLE)"),
    stage(action="CASE WHEN NOT admitted THEN 'discard' WHEN quality >= 70 THEN 'keep' WHEN quality >= 50 THEN 'demote' ELSE 'discard' END"),
)

#: The register of sources: parameters. Domains count with their subdomains; the last of each list suit the given corpus.
REGISTER = {
    "exchange_announcement": ("sec.gov", "londonstockexchange.com", "deutsche-boerse.com", "euronext.com", "thther.example.org", "ththwh.example.org"),
    "company_official": ("company.example.com", "ththhe.example.com", "therer.example.com"),
    "mainstream_media": ("reuters.com", "bbc.co.uk", "lemonde.fr", "faz.net", "elpais.com", "ththre.example.com", "therha.example.com"),
    "industry_media": ("eetimes.com", "heise.de", "usinenouvelle.com", "ththed.example.org", "therin.example.net"),
    "social_discussion": ("reddit.com", "x.com", "stocktwits.com", "ththth.example.net", "therou.example.com"),
}
#: Credit, verification and eligibility of each class of source.
CREDIT_OF = {
    "exchange_announcement": (98, "confirmed"), "company_ir": (88, "confirmed"), "company_official": (85, "confirmed"), "broker_research": (72, "professional"),
    "mainstream_media": (65, "professional"), "industry_media": (55, "professional"), "social_discussion": (35, "unverified"), "unknown_web": (30, "unverified"), "missing_source": (10, "missing"),
}


def _of(name: str) -> str:
    return "(" + " OR ".join(f"domain = '{d}' OR domain LIKE '%.{d}'" for d in REGISTER[name]) + ")"


CREDIT: tuple[Stage, ...] = (
    stage(host=host("url"), url_path="lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+([^?#]*)', 1))"),
    stage(domain="CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) WHEN starts_with(host, 'm.') THEN substr(host, 3) ELSE host END"),
    stage(
        source_type=both(
            "CASE WHEN domain IS NULL THEN 'missing_source' WHEN "
            + _of("exchange_announcement") + " THEN 'exchange_announcement' WHEN {0} THEN 'company_ir' WHEN " + _of("company_official")
            + " THEN 'company_official' WHEN starts_with(domain, 'research.') THEN 'broker_research' WHEN " + _of("mainstream_media") + " THEN 'mainstream_media' WHEN "
            + _of("industry_media") + " THEN 'industry_media' WHEN starts_with(domain, 'blog.') OR starts_with(domain, 'forum.') OR " + _of("social_discussion") + " THEN 'social_discussion' ELSE 'unknown_web' END",
            match_re("url_path", "^/(ir|investor|announcement)(/|$)"),
        )
    ),
    stage(
        source_credit="CASE source_type " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in CREDIT_OF.items()) + " END",
        verification="CASE source_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in CREDIT_OF.items()) + " END",
    ),
    stage(
        knowledge_eligible="source_credit >= 55",
        report_eligible="source_credit >= 65",
        claim_tier="CASE WHEN source_credit >= 80 THEN 'high' WHEN source_credit >= 55 THEN 'medium' WHEN source_credit >= 30 THEN 'low' ELSE 'drop' END",
        usage="""CASE WHEN source_credit >= 80 AND verification = 'confirmed' THEN 'core_fact_allowed' WHEN source_type IN ('broker_research', 'mainstream_media', 'industry_media') THEN 'professional_observation'
 WHEN source_type = 'social_discussion' THEN 'discussion_only' WHEN source_type = 'unknown_web' THEN 'lead_only' ELSE 'excluded' END""",
    ),
)
#: scheme, default prefixes, fragment and tracking parameters go; the path keeps its case.
CANONICAL: tuple[Stage, ...] = (
    *CREDIT,
    stage(path=replace_re("regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+([^?#]*)', 1)", "/+$", "")),
    stage(query=replace_re("regexp_extract(url, '[?]([^#]*)', 1)", "(^|&)(utm_[a-z]+|ref|spm|from)=[^&]*", "")),
    stage(canonical=("concat(domain, path, CASE WHEN query = '' THEN '' ELSE concat('?', ltrim('&', query)) END)", "concat(domain, path, CASE WHEN query = '' THEN '' ELSE concat('?', ltrim(query, '&')) END)")),
)
PAGE_ROWS = "SELECT page_id, url, html FROM pages"

STRIP: tuple[Stage, ...] = (
    stage(plain=replace_re("html", "<[^>]*>", " ")),
    stage(plain="replace(replace(replace(replace(replace(plain, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"),
    stage(plain=replace_re("plain", "[ \t\n\r]+", " ")),
    stage(plain="trim(plain)"),
)

#: Sentences of documents, with their place; a source per tier of credit.
SENTENCES = (
    """SELECT doc_id, pos, trim(sentence) AS sentence, source, lang, tier_no FROM (
  SELECT doc_id, source, lang, TRY_CAST(substr(source, 4) AS INT) % 4 AS tier_no, posexplode(split(text, '[.!?] ')) AS (pos, sentence) FROM documents) x WHERE length(trim(sentence)) >= 18""",
    """SELECT doc_id, pos, trim(sentence) AS sentence, source, lang, tier_no FROM (
  SELECT doc_id, source, lang, TRY_CAST(substr(source, 4) AS INTEGER) % 4 AS tier_no, unnest(range(len(p))) AS pos, unnest(p) AS sentence FROM (SELECT *, regexp_split_to_array(text, '[.!?] ') AS p FROM documents) y) x WHERE length(trim(sentence)) >= 18""",
)


def on_sentences(stages, *select: str, where=None, final=None) -> Query:
    return Query(SENTENCES, tuple(stages), ("doc_id", "CAST(pos AS BIGINT) AS pos", *select), where, final, DOCS)


def posts(stages, *select, where=None, final=None) -> Query:
    return Query(POSTS, tuple(stages), ("seq", *select), where, final, DOCS)


def pages(stages, *select, where=None, final=None) -> Query:
    return Query(PAGE_ROWS, tuple(stages), ("page_id", *select), where, final, PAGES)


def theme(name: str, column: str = "content") -> str:
    return f"has({column}, {name})"


def dense_refs(key: str, by: str = "source", width: int = 4096) -> str:
    """(by, key, ref): dense ranks of `key` within `by` over table t, in two steps, so that a frequent `by` isn't one task:
    ranks within ranges of keys, plus how many keys the ranges before hold."""
    return f"""WITH d AS (SELECT DISTINCT {by}, {key}, floor({key} / {width}) AS part FROM t),
c AS (SELECT {by}, part, count(*) AS n FROM d GROUP BY {by}, part),
o AS (SELECT {by}, part, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT d.{by}, d.{key}, CAST(o.before + row_number() OVER (PARTITION BY d.{by}, d.part ORDER BY d.{key}) AS BIGINT) AS ref FROM d JOIN o ON d.{by} = o.{by} AND d.part = o.part"""


#: Claims of low-credit sources are matched to those of better ones about the same topic in the same language.
CLAIM_SOURCE = (
    """SELECT doc_id, lang, source, TRY_CAST(substr(source, 4) AS INT) AS src, text, CAST(doc_id % 60 AS INT) AS day FROM documents""",
    """SELECT doc_id, lang, source, TRY_CAST(substr(source, 4) AS INTEGER) AS src, text, CAST(doc_id % 60 AS INTEGER) AS day FROM documents""",
)
#: Terms that name one thing, and terms that many texts share.
SPECIFIC = ("mit license", "apache license", "public license", "cc by", "creative commons", "akia", "+1 (", "api_key", "worthless")
GENERIC = ("license", "version", "released", "token", "password", "mail", "@", " | ", "stupid")
TOPICS = {"rights": "policy", "access": "secret", "contact": "contact", "finance": "finance", "conduct": "abuse"}


def listed(terms: tuple[str, ...], column: str) -> tuple[str, str]:
    """The terms that a lower-cased text holds, comma-joined in the order of the list."""
    array = ", ".join("'" + t + "'" for t in terms)
    return f"array_join(filter(array({array}), x -> contains({column}, x)), ',')", f"array_to_string(list_filter([{array}], lambda x: contains({column}, x)), ',')"


CLAIMS: tuple[Stage, ...] = (
    stage(
        credit="CASE WHEN src % 5 = 0 THEN 90 WHEN src % 5 = 1 THEN 60 WHEN src % 5 = 2 THEN 35 ELSE 20 END",
        low_text="lower(coalesce(text, ''))",
        topics="concat_ws(',', " + ", ".join(f"CASE WHEN has(text, {v}) THEN '{k}' END" for k, v in TOPICS.items()) + ")",
    ),
    stage(where="topics <> '' AND credit >= 30"),
    stage(claim_tier="CASE WHEN credit >= 80 THEN 'high' WHEN credit >= 55 THEN 'medium' ELSE 'low' END", specific=listed(SPECIFIC, "low_text"), generic=listed(GENERIC, "low_text")),
)
_CUT, _MEET = ("split({0}, ',')", "string_split({0}, ',')"), ("arrays_overlap", "list_has_any")


def _shared(k: int, c: str) -> str:
    return f"(l.{c} <> '' AND s.{c} <> '' AND {_MEET[k]}({_CUT[k].format('l.' + c)}, {_CUT[k].format('s.' + c)}))"


#: Claims with the same topics, terms and day score alike, so only their few combinations are paired, not the claims: a shared
#: specific term 60, a shared generic one 10, dates within 30 days 10. Access and contact topics are compatible.
SCORED = tuple(
    f"""WITH s AS (SELECT lang, claim_tier, topics, specific, generic, day, min(doc_id) AS source_claim FROM t WHERE claim_tier <> 'low' GROUP BY lang, claim_tier, topics, specific, generic, day),
l AS (SELECT DISTINCT lang, topics, specific, generic, day FROM t WHERE claim_tier = 'low'),
p AS (SELECT l.lang, l.topics, l.specific, l.generic, l.day, s.claim_tier, s.source_claim, {_shared(k, "specific")} AS is_specific,
    CASE WHEN {_shared(k, "specific")} THEN 60 ELSE 0 END + CASE WHEN {_shared(k, "generic")} THEN 10 ELSE 0 END + CASE WHEN abs(l.day - s.day) <= 30 THEN 10 ELSE 0 END AS score
  FROM l JOIN s ON l.lang = s.lang AND ({_shared(k, "topics")} OR (l.topics LIKE '%access%' AND s.topics LIKE '%contact%') OR (l.topics LIKE '%contact%' AND s.topics LIKE '%access%'))),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, topics, specific, generic, day ORDER BY CASE WHEN claim_tier = 'high' AND is_specific THEN 0 WHEN claim_tier = 'high' THEN 1 ELSE 2 END, score DESC, source_claim) AS rk FROM p WHERE score > 0),
v AS (SELECT c.doc_id, c.lang, c.topics, c.text, b.claim_tier, b.score, b.source_claim,
    CASE WHEN b.claim_tier = 'high' AND b.is_specific THEN 'verified' WHEN b.claim_tier = 'high' THEN 'needs_review' WHEN b.claim_tier = 'medium' AND b.is_specific THEN 'supported' ELSE 'unverified' END AS action
  FROM (SELECT * FROM t WHERE claim_tier = 'low') c LEFT JOIN (SELECT * FROM b WHERE rk = 1) b
    ON c.lang = b.lang AND c.topics = b.topics AND c.specific = b.specific AND c.generic = b.generic AND c.day = b.day),
w AS (SELECT *, CAST(CASE action WHEN 'verified' THEN least(100, 70 + floor(score / 5)) WHEN 'needs_review' THEN 0 WHEN 'supported' THEN least(69, 40 + floor(score / 5)) ELSE 20 END AS BIGINT) AS confidence FROM v)"""
    for k in (0, 1)
)
VERIFY = tuple(f"{x} SELECT doc_id, topics, action, confidence, CASE WHEN action <> 'unverified' THEN source_claim END AS verified_by FROM w" for x in SCORED)

#: Labels before an amount or a rate.
LABELS = "(revenue|profit|cash|margin|share|version|page|price|order|umsatz|gewinn|anteil|chiffre|marge|ingresos|precio|mail)"

#: Reports: documents as sections of Markdown with citation marks.
REPORTS = "SELECT doc_id, text, CAST(doc_id % 5 AS INT) AS body_refs, CAST(doc_id % 7 AS INT) AS table_refs FROM documents"

QUERIES: dict[str, Query] = {
    "q_s12_platform_of_url": pages((stage(host=host("url")), stage(platform="CASE WHEN contains(host, 'blog.') THEN 'blog' WHEN starts_with(host, 'm.') THEN 'mobile' WHEN starts_with(host, 'www.') THEN 'web' ELSE 'other' END")), "host", "platform"),
    "q_s21_html_clean": pages(STRIP, both("{0} AS plain_sha", sha256("plain")), "CAST(length(plain) AS BIGINT) AS plain_chars"),
    "q_s23_interactions": Query("SELECT doc_id, concat('likes ', CAST(doc_id * 7 % 100 AS VARCHAR(9)), ' comments ', CAST(doc_id % 30 AS VARCHAR(9)), CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' reposts 4' END) AS line FROM documents", (stage(likes="CAST(nullif(regexp_extract(line, 'likes ([0-9]+)', 1), '') AS INT)", comments="CAST(nullif(regexp_extract(line, 'comments ([0-9]+)', 1), '') AS INT)", reposts="CAST(nullif(regexp_extract(line, 'reposts ([0-9]+)', 1), '') AS INT)"),), ("doc_id", "likes", "comments", "reposts"), tables=DOCS),
    "q_s25_intake_status": Query(POSTS, FLAGS, final="SELECT source, count(*) AS items, CASE WHEN count(*) = 0 THEN 'empty' WHEN sum(interaction) < 1000 THEN 'partial' ELSE 'ok' END AS status FROM t GROUP BY source", tables=DOCS),
    "q_s26_lookback": posts((stage(inside="coalesce(published BETWEEN DATE '2024-06-01' AND DATE '2025-03-01', true)"),), "published", "inside"),
    "q_s27_category": posts((stage(category="CASE WHEN has(content, policy) THEN 'notice' WHEN has(content, finance) THEN 'finance' WHEN has(content, event) THEN 'event' WHEN has(content, contact) THEN 'contact' ELSE 'other' END", low_signal="length(content) < 120 OR (terms(content, signal) = 0 AND terms(content, logic) = 0)", stock_reference=match_re("content", "[(][0-9]{6}[)]|[$][A-Z]{1,5}[$]?|[0-9]{6}[.](?:SH|SZ|HK)")),), "category", "low_signal", "stock_reference"),
    "q_s28_jsonp": Query("SELECT event_id, concat('cb(', props, ');') AS payload FROM events", (stage(inner_json=first_re("payload", "^[a-z]+[(](.*)[)];$")), stage(k=("CAST(get_json_object(inner_json, '$.k') AS BIGINT)", "CAST(json_extract_string(inner_json, '$.k') AS BIGINT)"))), ("event_id", "k"), tables=("events",)),
    "q_s30_queries": Query(("SELECT s_suppkey, explode(array(concat(s_name, ' results'), concat(s_name, ' risk'), concat(s_name, ' order'))) AS q FROM supplier", "SELECT s_suppkey, unnest([concat(s_name, ' results'), concat(s_name, ' risk'), concat(s_name, ' order')]) AS q FROM supplier"), (), ("s_suppkey", "q"), tables=("supplier",)),
    "q_s31_report_choice": posts((stage(year="year(published)", fits="CASE WHEN has(content, annual_report) THEN 0 WHEN has(content, policy) OR has(content, finance) THEN 1 ELSE 2 END"), stage(rk="row_number() OVER (PARTITION BY source, year ORDER BY fits, seq)")), "source", "year", where="rk = 1"),
    "q_q01_hard_gate": posts(GATE, "gate"),
    "q_q02_rule_score": posts(SCORE, "round(quality, 4) AS quality"),
    "q_q03_action": posts(SCORE, "action"),
    "q_q04_gate_pipeline": Query(POSTS, SCORE, final="SELECT action, count(*) AS items, round(min(quality), 4) AS lowest, round(max(quality), 4) AS highest FROM t GROUP BY action", tables=DOCS),
    "q_q06_featured": posts((*FLAGS, stage(cut="contains(both_texts, '...')"), stage(featured="(cut AND data_kinds > 0 AND logic_words > 0) OR (n >= 80 AND likes + comments > 5)")), "featured"),
    "q_q07_content_score": posts((*FLAGS, stage(score="CAST(CASE WHEN contains(both_texts, '...') THEN 3 ELSE 0 END + CASE WHEN data_kinds > 0 THEN 2 ELSE 0 END + CASE WHEN logic_words > 0 THEN 2 ELSE 0 END + CASE WHEN key_words > 0 THEN 1 ELSE 0 END + CASE WHEN likes + comments > 20 THEN 2 WHEN likes + comments > 10 THEN 1 WHEN likes + comments > 3 THEN 0.5 ELSE 0 END + least(n / 100.0, 3.0) AS DOUBLE)")), "round(score, 4) AS score"),
    "q_q08_funnel": posts((*SCORE, stage(age=("datediff(DATE '2025-06-01', published)", "datediff('day', published, DATE '2025-06-01')"), ttl="CASE WHEN has(content, policy) THEN 180 WHEN contains(content, ' | ') THEN 90 WHEN n > 2000 THEN 60 ELSE 14 END"), stage(level="CASE WHEN age > 365 OR age < 0 THEN 'L1_old' WHEN quality < 30 THEN 'L2_poor' WHEN age > ttl THEN 'L3_expired' ELSE 'kept' END")), "CAST(age AS INT) AS age", "ttl", "level"),
    "q_q09_web_score": pages((*CREDIT, *STRIP, stage(title=first_re("html", "<h1>([^<]*)</h1>"), content="plain", likes="0", comments="0", reposts="0"), *FLAGS, stage(relevance="least(25, title_words * 10 + logic_words * 2)", credibility="CAST(floor(source_credit / 4) AS INT)", evidence="least(20, data_kinds * 5)", substance="least(20, CAST(floor(n / 100) AS INT))", engagement="least(10, CAST(floor(interaction / 10) AS INT))"), stage(total="relevance + credibility + evidence + substance + engagement"), stage(verdict="CASE WHEN knowledge_eligible THEN CASE WHEN total >= 60 THEN 'keep' WHEN total >= 35 THEN 'demote' ELSE 'drop' END ELSE CASE WHEN total >= 50 THEN 'keep' WHEN total >= 30 THEN 'demote' ELSE 'drop' END END")), "source_type", "CAST(total AS INT) AS total", "verdict"),
    "q_q10_portal_page": pages((*STRIP, stage(links=count_re("html", "<a "), blocks=count_re("html", "<p>"), title=first_re("html", "<title>([^<]*)")), stage(portal="(CASE WHEN links > 0.5 * greatest(blocks, 1) THEN 1 ELSE 0 END + CASE WHEN length(plain) / greatest(blocks, 1) < 40 THEN 1 ELSE 0 END + CASE WHEN contains(html, '<nav>') AND contains(html, '<footer>') THEN 1 ELSE 0 END + CASE WHEN length(title) < 8 THEN 1 ELSE 0 END) >= 2")), "portal"),
    "q_q11_topics": posts((stage(**{f"is_{k}": theme(w) for k, w in THEMES.items()}), stage(topics="concat_ws(',', CASE WHEN is_growth THEN 'growth' END, CASE WHEN is_risk THEN 'risk' END, CASE WHEN is_policy THEN 'policy' END, CASE WHEN is_finance THEN 'finance' END)")), "CASE WHEN topics = '' THEN 'sentiment_only' ELSE topics END AS topics"),
    "q_q13_attempts": Query(POSTS, (*FLAGS, stage(h=sha256("content")), stage(dup="row_number() OVER (PARTITION BY h ORDER BY seq)"), stage(drop_reason="CASE WHEN n < 80 THEN 'too_short' WHEN dup > 1 THEN 'duplicate' WHEN interaction < 5 THEN 'no_interaction' END")), final="SELECT source, count(*) AS attempts, count(drop_reason) AS dropped, count(drop_reason) > 0.4 * count(*) AS refill FROM t GROUP BY source", tables=DOCS),
    "q_q14_triage": posts((*FLAGS, stage(h=sha256("content")), stage(dup="row_number() OVER (PARTITION BY h ORDER BY seq)"), stage(triage="CASE WHEN dup > 1 THEN 'duplicate' WHEN n < 100 THEN 'drop' WHEN contains(content, ' | ') THEN 'product_signal' ELSE 'keep' END", triage_score="CAST(least(80, logic_words * 8 + data_kinds * 10) AS INT)")), "triage", "triage_score"),
    "q_q16_research_select": posts((*FLAGS, stage(uid=sha256("coalesce(content, '')"), rank_score="logic_words + data_kinds"), stage(best="row_number() OVER (PARTITION BY uid ORDER BY rank_score DESC, seq)"), stage(where="best = 1"), stage(recent=("datediff(DATE '2025-06-01', published) BETWEEN 0 AND 90", "datediff('day', published, DATE '2025-06-01') BETWEEN 0 AND 90"), wide=("datediff(DATE '2025-06-01', published) BETWEEN 0 AND 180", "datediff('day', published, DATE '2025-06-01') BETWEEN 0 AND 180")), stage(n_recent="count(CASE WHEN recent THEN 1 END) OVER (PARTITION BY source)"), stage(where="CASE WHEN n_recent >= 3 THEN recent ELSE wide END"), stage(rk="row_number() OVER (PARTITION BY source ORDER BY published DESC, rank_score DESC, seq)")), "source", "published", "CAST(rank_score AS INT) AS rank_score", where="rk <= 5"),
    "q_d01_domain": pages(CREDIT, "domain"),
    "q_d02_source_credit": pages(CREDIT, "source_type", "source_credit", "verification", "knowledge_eligible", "report_eligible"),
    "q_d03_usage_tier": pages((*CREDIT, stage(credit_tier="CASE usage WHEN 'core_fact_allowed' THEN 'high' WHEN 'professional_observation' THEN 'medium' ELSE 'low' END")), "usage", "credit_tier"),
    "q_d04_core_fact_support": pages((*CREDIT, stage(supports="source_type = 'exchange_announcement' OR (source_credit >= 80 AND verification = 'confirmed')")), "supports"),
    "q_d05_layer_policy": pages((*CREDIT, stage(layer="CASE WHEN verification IN ('verified_discussion', 'supported_discussion') THEN 'bridge_summary' WHEN source_type = 'social_discussion' THEN 'external_viewpoint' WHEN source_type IN ('broker_research', 'mainstream_media') AND NOT report_eligible THEN 'formal_display' WHEN usage = 'core_fact_allowed' THEN 'canonical' WHEN usage = 'professional_observation' THEN 'formal_display' ELSE 'excluded' END")), "layer"),
    "q_d07_intake_merge": pages((*CANONICAL, stage(merge_key=both("coalesce(canonical, {0})", sha256("html"))), stage(rk="row_number() OVER (PARTITION BY merge_key ORDER BY source_credit DESC, CASE WHEN source_type = 'exchange_announcement' THEN 0 ELSE 1 END, page_id)")), "merge_key", "source_credit", where="rk = 1"),
    # without an address, a record is its source and whole text; the first is kept
    "q_d08_record_dedupe": posts((stage(k=sha256("coalesce(content, '')")), stage(rk="row_number() OVER (PARTITION BY source, k ORDER BY seq)")), "source", where="rk = 1"),
    "q_d13_unit_numbers": on_sentences((stage(numbers=all_re("sentence", "[0-9]+(?:[.][0-9]+)?")), stage(number_set=("array_join(array_sort(array_distinct(numbers)), ' ')", "array_to_string(list_sort(list_distinct(numbers)), ' ')"))), "number_set", where=("size(numbers) > 0", "len(numbers) > 0")),
    "q_d15_note_identity": pages((*CANONICAL, stage(note_id=both("CASE WHEN canonical IS NOT NULL THEN concat('url:', regexp_replace(domain || path, '[.](html|htm|php)$', '')) ELSE concat('sha:', {0}) END", sha256("html")))), "note_id"),
    "q_d16_claim_status": pages(CREDIT, "claim_tier"),
    "q_d17_union": Query("SELECT 'doc' AS origin, doc_id AS id, source AS platform, substr(text, 1, 60) AS title FROM documents UNION ALL SELECT 'page', page_id, 'web', url FROM pages UNION ALL SELECT 'chat', conv_id * 1000 + turn, role, substr(text, 1, 60) FROM conversations", (), ("origin", "id", "platform", "title"), tables=("documents", "pages", "conversations")),
    "q_d18_viewpoint_dedupe": posts(
        (
            *SCORE,
            stage(cluster_no="CASE WHEN has(content, policy) THEN 1 WHEN has(content, finance) THEN 2 WHEN has(content, risk) THEN 3 WHEN has(content, driver) THEN 4 ELSE 5 END"),
            stage(is_long="n > 6000", rk="row_number() OVER (PARTITION BY source, lang, cluster_no ORDER BY quality DESC, n DESC, seq)"),
            # up to three further cards of long reports stay for each stock
            stage(protected="row_number() OVER (PARTITION BY lang, CASE WHEN is_long AND rk > 1 THEN 1 ELSE 0 END ORDER BY quality DESC, n DESC, seq)"),
        ),
        "source", "lang", "cluster_no", "round(quality, 4) AS quality", "rk > 1 AS is_protected", where="rk = 1 OR (is_long AND protected <= 3)",
    ),
    "q_c01_claim_id": on_sentences((stage(claim_id=both("substr({0}, 1, 12)", sha256("concat_ws('|', source, sentence)"))),), "claim_id"),
    # without addresses and citation marks, letters and digits of any script
    "q_c02_claim_merge": Query(SENTENCES, (stage(bare=replace_re("lower(sentence)", "https?://[^ ]+|[\\[]\\^?[0-9]+[\\]]", "")), stage(norm=replace_re("bare", "[^\\p{L}\\p{N}]+", "")), stage(where="length(norm) >= 12"), stage(norm_key=sha256("norm"))), final="SELECT norm_key, count(*) AS mentions, count(DISTINCT source) AS sources, max(tier_no) AS best_tier, min(doc_id) AS first_doc FROM t GROUP BY norm_key HAVING count(*) > 1", tables=DOCS),
    "q_c04_topic": on_sentences(
        (
            stage(topics="concat_ws(',', " + ", ".join(f"CASE WHEN has(sentence, {v}) THEN '{k}' END" for k, v in TOPICS.items()) + ")"),
            stage(topic="CASE WHEN topics <> '' THEN topics WHEN tier_no = 0 THEN 'official' ELSE 'general' END"),
        ),
        "topic", where="topic <> 'general'",
    ),
    "q_c05_credit_tier": Query(CLAIM_SOURCE, CLAIMS, ("doc_id", "credit", "claim_tier"), "claim_tier <> 'low'", tables=DOCS),
    "q_c07_verify": Query(CLAIM_SOURCE, CLAIMS, final=VERIFY, tables=DOCS),
    "q_c09_risk_signals": on_sentences((stage(signal=both("CASE WHEN has(sentence, abuse) AND NOT has(sentence, not_abuse) THEN 'abuse' WHEN has(sentence, secret) THEN 'leak' WHEN {0} THEN 'licence_limit' WHEN has(sentence, risk) AND NOT has(sentence, abuse) THEN 'loss' WHEN has(sentence, qualified_opinion) AND NOT has(sentence, clean_opinion) THEN 'audit' END", match_re("sentence", "BY-NC"))),), "signal", where="signal IS NOT NULL"),
    "q_n03_direct_relevance": posts((stage(direct="CASE WHEN has(title, product) OR has(title, finance) THEN 'title' WHEN has(content, product) THEN 'product' WHEN has(content, peer) THEN 'peer' WHEN has(content, own) THEN 'name' ELSE 'none' END"),), "direct"),
    "q_n04_theme_budget": Query(
        POSTS, (stage(**{f"is_{k}": theme(w) for k, w in THEMES.items()}), ),
        final=" UNION ALL ".join(f"SELECT source, '{k}' AS theme, count(*) AS items, min(seq) AS first_ref, max(seq) AS last_ref FROM t WHERE is_{k} GROUP BY source" for k in THEMES), tables=DOCS,
    ),
    "q_n05_evidence_profile": Query(POSTS, SCORE, final="SELECT source, count(CASE WHEN action = 'keep' THEN 1 END) AS formal, count(DISTINCT lang) AS langs, CASE WHEN count(CASE WHEN action = 'keep' THEN 1 END) >= 20 THEN 'formal_rich' WHEN count(CASE WHEN action <> 'discard' THEN 1 END) >= 10 THEN 'medium' WHEN count(*) >= 40 THEN 'thin_external_rich' ELSE 'thin_all' END AS profile FROM t GROUP BY source", tables=DOCS),
    "q_n06_freshness": Query(POSTS, (stage(age=("datediff(DATE '2025-06-01', published)", "datediff('day', published, DATE '2025-06-01')")),), final="SELECT source, CAST(max(published) AS VARCHAR(10)) AS latest, CASE WHEN max(CASE WHEN age BETWEEN 0 AND 120 THEN 1 ELSE 0 END) = 1 THEN 'fresh' WHEN min(age) < 0 THEN 'unknown' ELSE 'stale' END AS freshness FROM t GROUP BY source", tables=DOCS),
    "q_n07_topic_families": on_sentences((stage(families="CAST(has(sentence, driver) AS INT) + CAST(has(sentence, policy) AS INT) + CAST(has(sentence, contact) AS INT) + CAST(has(sentence, finance) AS INT)"),), "families", where="families > 1"),
    "q_e01_blocks": Query(
        ("SELECT doc_id, pos, block FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (pos, block) FROM documents) x WHERE trim(block) <> ''", "SELECT doc_id, pos, block FROM (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS block FROM (SELECT doc_id, string_split(text, '\n') AS p FROM documents) y) x WHERE trim(block) <> ''"),
        (stage(block_hash=sha256("block"), noise="length(block) < 20 OR contains(block, '!!')"),), ("doc_id", "CAST(pos AS BIGINT) AS pos", "block_hash", "noise"), tables=DOCS,
    ),
    "q_e04_argument_cards": Query(
        SENTENCES,
        (stage(family="CASE WHEN has(sentence, driver) THEN 'driver' WHEN has(sentence, event) THEN 'event' ELSE 'other' END"), stage(_new="CASE WHEN family = lag(family) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END"), stage(run="CAST(sum(_new) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)")),
        final="SELECT doc_id, run, min(family) AS family, count(*) AS units, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM t GROUP BY doc_id, run", tables=DOCS,
    ),
    "q_e07_narrative_plan": Query(
        SENTENCES, (stage(topic="CASE WHEN has(sentence, policy) THEN 1 WHEN contains(sentence, '@') THEN 2 ELSE 3 END"),),
        final=("SELECT doc_id, topic, array_join(transform(array_sort(collect_list(pos)), x -> CAST(x AS STRING)), ',') AS plan FROM t WHERE topic < 3 GROUP BY doc_id, topic", "SELECT doc_id, topic, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS plan FROM t WHERE topic < 3 GROUP BY doc_id, topic"), tables=DOCS,
    ),
    "q_e08_citation_lint": on_sentences((stage(strong="has(sentence, strong)", low_credit="tier_no IN (2, 3)"), stage(violation="strong AND low_credit")), "violation", where="violation"),
    "q_x01_clean": Query("SELECT doc_id, text FROM documents", (stage(c=replace_re("text", r"\[[0-9]+\]", "")), stage(c=("regexp_replace(c, '([0-9]) +%', '$1%')", "regexp_replace(c, '([0-9]) +%', '\\1%', 'g')")), stage(clean_sha=sha256("c"))), ("doc_id", "clean_sha", "CAST(length(c) AS BIGINT) AS clean_chars"), tables=DOCS),
    "q_x02_report_type": Query(
        "SELECT doc_id, text, substr(text, 1, 5000) AS head FROM documents",
        (
            stage(
                report_type="CASE WHEN has(head, annual_report) THEN 'annual' WHEN has(head, half_report) THEN 'half_year' WHEN has(head, quarter_report) THEN 'quarterly' WHEN has(head, policy) THEN 'notice' ELSE 'unknown' END",
                opinion="CASE WHEN has(text, clean_opinion) AND NOT has(text, qualified_opinion) THEN 'unqualified' WHEN has(text, qualified_opinion) THEN 'qualified' ELSE 'none' END",
            ),
        ),
        ("doc_id", "report_type", "opinion"), tables=DOCS,
    ),
    "q_x04_sentence_rank": on_sentences((stage(score="terms(sentence, signal) + CAST(has(sentence, contact) AS INT) + CAST(has(sentence, risk) AS INT)", prefix="substr(sentence, 1, 60)"), stage(where="score > 0"), stage(dup="row_number() OVER (PARTITION BY doc_id, prefix ORDER BY score DESC, pos)"), stage(where="dup = 1"), stage(rk="row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos)")), "score", "CAST(rk AS BIGINT) AS rk", where="rk <= 5"),
    "q_x21_labelled_amount": on_sentences(
        (
            stage(label=first_re("lower(sentence)", LABELS), raw=first_re("lower(sentence)", LABELS + "[^0-9]{0,20}([0-9]+(?:[.,][0-9]+)*)", 2), unit=first_re("lower(sentence)", LABELS + "[^0-9]{0,20}[0-9]+(?:[.,][0-9]+)* ?(%|million|mio|billion|mrd|milliard|thousand|tsd)?", 2)),
            stage(amount="try_cast(nullif(replace(raw, ',', ''), '') AS DOUBLE) * CASE unit WHEN 'million' THEN 1000000 WHEN 'mio' THEN 1000000 WHEN 'billion' THEN 1000000000 WHEN 'mrd' THEN 1000000000 WHEN 'milliard' THEN 1000000000 WHEN 'thousand' THEN 1000 WHEN 'tsd' THEN 1000 ELSE 1 END", kind="CASE WHEN unit = '%' THEN 'rate' ELSE 'amount' END"),
        ),
        "label", "kind", "amount", where="amount IS NOT NULL",
    ),
    "q_x20_coverage": Query(SENTENCES, (stage(section="CAST(floor(pos / 5) AS BIGINT)", prio="length(sentence) > 60", chosen="has(sentence, driver)"),), final="SELECT doc_id, section, count(*) AS extracted, count(CASE WHEN prio THEN 1 END) AS prioritised, count(CASE WHEN prio AND chosen THEN 1 END) AS selected FROM t GROUP BY doc_id, section", tables=DOCS),
    "q_g01_length_class": posts((stage(n="length(content)"), stage(length_class="CASE WHEN n <= 1500 THEN 'short' WHEN n <= 6000 THEN 'medium' ELSE 'long' END"), stage(cards="CASE length_class WHEN 'short' THEN 3 WHEN 'medium' THEN 5 ELSE 8 END")), "length_class", "cards"),
    "q_g03_candidate_score": on_sentences((stage(signal="terms(sentence, signal)", noise=count_re("sentence", "[!#$%&*|]")), stage(score="CAST(least(60, signal * 15) + CASE WHEN length(sentence) > 80 THEN 12 ELSE 4 END + 8 - least(40, noise * 2) AS INT)"), stage(severe="noise >= 20")), "score", "severe"),
    "q_g05_driver_score": on_sentences((stage(clusters="CAST(has(sentence, driver) AS INT) + CAST(has(sentence, policy) AS INT) + CAST(has(sentence, event) AS INT)", words_found="terms(sentence, driver) + terms(sentence, policy) + terms(sentence, event)"), stage(driver_score="3 * clusters + 2 * words_found")), "CAST(driver_score AS INT) AS driver_score", where="clusters > 0"),
    "q_a02_card_errors": on_sentences((stage(errors="concat_ws(',', CASE WHEN length(sentence) > 500 THEN 'too_long' END, CASE WHEN contains(sentence, '!!') THEN 'noise' END, CASE WHEN contains(sentence, '|') THEN 'table_fragment' END)"),), "errors", where="errors <> ''"),
    "q_a03_excerpt_score": on_sentences((stage(score="CAST(least(10, greatest(0, 5 + CASE WHEN has(sentence, driver) THEN 1 ELSE 0 END + CASE WHEN length(sentence) > 120 THEN 1 ELSE 0 END - CASE WHEN contains(sentence, '!!') THEN 3 ELSE 0 END - CASE WHEN length(sentence) < 40 THEN 1 ELSE 0 END)) AS INT)"),), "score"),
    "q_a05_snapshot_refs": Query(
        POSTS, (*SCORE, stage(where="action <> 'discard'")),
        final=(
            f"SELECT x.seq, x.source, r.ref, x.action FROM t x JOIN ({dense_refs('seq')}) r ON x.source = r.source AND x.seq = r.seq",
            "SELECT seq, source, CAST(dense_rank() OVER (PARTITION BY source ORDER BY seq) AS BIGINT) AS ref, action FROM t",
        ),
        tables=DOCS, once=("seq", "source", "action"),
    ),
    "q_l01_citations": Query(
        "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        (
            # the table of sources is what follows a line that names it; marks before it are the body's
            stage(cut=("regexp_instr(lower(text), r'\n#* *(?:references|sources|quellen|fuentes)')", "CASE WHEN regexp_matches(lower(text), '\n#* *(?:references|sources|quellen|fuentes)') THEN length(regexp_extract(lower(text), '^(?s:(.*?))\n#* *(?:references|sources|quellen|fuentes)', 1)) + 1 ELSE 0 END")),
            stage(body="CASE WHEN cut > 0 THEN substr(text, 1, cut - 1) ELSE text END", sources="CASE WHEN cut > 0 THEN substr(text, cut) ELSE '' END"),
            stage(b=all_re("body", "\\[\\^?([0-9]+)\\]", 1), c=all_re("sources", "\\[\\^?([0-9]+)\\]", 1)),
            stage(missing=("size(array_except(b, c))", "len(list_filter(list_distinct(b), lambda x: NOT list_contains(c, x)))"), unused=("size(array_except(c, b))", "len(list_filter(list_distinct(c), lambda x: NOT list_contains(b, x)))")),
            stage(issue="CASE WHEN missing > 0 THEN 'global_citation_missing_refs' WHEN unused > 0 THEN 'global_citation_unused_refs' END"),
        ),
        ("doc_id", "CAST(missing AS BIGINT) AS missing", "CAST(unused AS BIGINT) AS unused", "issue"), tables=DOCS,
    ),
    "q_l02_contradictions": stocks(
        (
            *RISK,
            stage(weak="trend_stage IN ('broken', 'weakening', 'near_break')", wants="final_label IN ('strong_buy', 'buy')"),
            stage(
                issues="""concat_ws(',', CASE WHEN weak AND total_score >= 8 THEN 'contradiction_weak_trend_high_total_score' END,
 CASE WHEN weak AND technical_score >= 8 THEN 'contradiction_weak_trend_high_technical_score' END,
 CASE WHEN health < 45 AND total_score >= 7.5 THEN 'contradiction_low_trend_health_high_total_score' END,
 CASE WHEN weak AND wants THEN 'contradiction_weak_trend_strong_recommendation' END,
 CASE WHEN wants AND constraint_code IN ('wait_for_entry', 'severe_technical') THEN 'contradiction_blocked_entry_strong_recommendation' END,
 CASE WHEN ev IS NULL THEN 'ev_na_percent' END, CASE WHEN wants AND risk_band IN ('high', 'very_high') THEN 'risk_position_label_mismatch' END)"""
            ),
        ),
        "issues",
    ),
    "q_l04_prose": on_sentences(
        (
            stage(norm=replace_re("lower(sentence)", "[^a-z0-9äöüßéèàçñ]+", " ")),
            stage(again="count(*) OVER (PARTITION BY doc_id, norm)", moves="sum(CASE WHEN has(sentence, logic) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id)", all_units="count(*) OVER (PARTITION BY doc_id)"),
            stage(issue="concat_ws(',', CASE WHEN length(sentence) > 300 THEN 'long_sentence' END, CASE WHEN again >= 3 THEN 'repeated_theme' END, CASE WHEN has(sentence, strong) THEN 'strong_assertion' END, CASE WHEN has(sentence, logic) AND moves >= 3 AND moves * 2 > all_units THEN 'transitions' END)"),
        ),
        "issue", where="issue <> ''",
    ),
    "q_l05_source_boundary": on_sentences((stage(bad="has(sentence, secret)"),), "bad", where="bad AND pos > 0"),
    "q_l06_citation_marks": Query(
        "SELECT doc_id, coalesce(text, '') AS line FROM documents",
        (
            stage(line=replace_re("line", r"\[\^[A-Za-z]+\]", "")),
            stage(line=(r"regexp_replace(line, r'\[([0-9]+)\]', '[^$1]')", r"regexp_replace(line, '\[([0-9]+)\]', '[^\1]', 'g')")),
            stage(line_sha=sha256("line"), marks=count_re("line", r"\[\^[0-9]+\]")),
        ),
        ("doc_id", "line_sha", "CAST(marks AS BIGINT) AS marks"), tables=DOCS, replaces=("line",),
    ),
    "q_r07_period_filter": posts((stage(y="year(published)", q="quarter(published)"), stage(where="y = 2024 AND q = 3")), "published"),
}
