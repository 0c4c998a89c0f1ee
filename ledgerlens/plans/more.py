"""Further queries: source freshness and priority, repair chains, selections with quotas, claim
extraction, filing text mining, near-duplicate cards, evidence packs and assembly, with their SQL."""

from __future__ import annotations

from ..functions.text import all_re, both, count_re, first_re, match_re, replace_re, sha256
from ..operators import structure as st
from ..operators import trend as tr
from ..operators.indicators import PREV
from ..sources.tables import BARS, FRIDAY
from .market import judged, triggered
from .scoring import hits
from .stages import Query, Stage, over, stage
from .texts import CANONICAL, CLAIM_SOURCE, CLAIMS, DOCS, PAGE_ROWS, PAGES, POSTS, SCORE, SCORED, SENTENCES

LINES = (
    "SELECT doc_id, source, pos, trim(line) AS line FROM (SELECT doc_id, source, posexplode(split(text, '\n')) AS (pos, line) FROM documents) x",
    "SELECT doc_id, source, pos, trim(line) AS line FROM (SELECT doc_id, source, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT *, string_split(text, '\n') AS p FROM documents) y) x",
)
HEADS: tuple[Stage, ...] = (
    stage(is_head="length(line) BETWEEN 1 AND 40"),
    stage(section="CAST(sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"),
    stage(heading="max(CASE WHEN is_head THEN line END) OVER (PARTITION BY doc_id, section)"),
)


def sentences(stages, *select: str, where=None, final=None) -> Query:
    return Query(SENTENCES, tuple(stages), ("doc_id", "CAST(pos AS BIGINT) AS pos", *select), where, final, DOCS)


_SO_FAR = over("UNBOUNDED PRECEDING AND CURRENT ROW")
_BEFORE_NOW = over("UNBOUNDED PRECEDING AND 1 PRECEDING")

#: Checks of a report's text: a pattern over its lower-cased text, or a condition in a tuple.
REPORT_RULES: dict[str, str | tuple[str]] = {
    "malformed_citation_marker": "\\[\\^[a-z]+\\]|\\[\\^\\]|\\[[0-9]+,\\]",
    "ev_na_percent": "n/a ?%",
    "financial_fact_unit_conflict": "(?:million|mio|milliard)[^.\n]{0,20}(?:thousand|tsd|mille )|[0-9]%[^.\n]{0,5}(?:million|mio)",
    "financial_data_missing_contradiction": "(?:no data|not available|keine angaben|non disponible|sin datos)[^.\n]{0,60}[0-9]+[.,][0-9]+",
    "financial_profit_direction_contradiction": "(?:profit|gewinn|bénéfice|beneficio)[^.\n]{0,30}(?:rose|stieg|augment|aument)[^.\n]{0,30}(?:-[0-9]|loss|verlust|perte|pérdida)",
    "fundflow_claim_without_fundflow_pack": "(?:net inflow|net outflow|mittelzufluss|flux net|flujo neto)",
    "industry_chain_unmatched_claim": "(?:upstream|downstream|supply chain|lieferkette|chaîne d.approvisionnement|cadena de suministro)",
    "vague_supply_chain_position": "(?:important|key|central) (?:link|position|player) in the (?:supply )?chain",
    "section_too_generic": ("length(text) > 0 AND NOT has(low, signal) AND NOT has(low, logic)",),
    "empty_executive_summary_body": "#+ *(?:executive summary|zusammenfassung|résumé|resumen)[ \n]*(?:#|$)",
    "header_config_missing": ("length(text) >= 60 AND NOT contains(substr(text, 1, 200), chr(10))",),
    "over_compressed": ("length(text) < 60",),
    "secret_in_text": ("has(low, secret)",),
    "shouting": "!! ?[a-z]",
    "empty_table_cell": "[|] *[|]",
    "core_fact_unknown_evidence": "(?:unknown source|source unknown|quelle unbekannt|source inconnue|fuente desconocida)",
    "external_map_unverified_claim_framing": "(?:unverified|unbestätigt|non vérifié|sin verificar)",
    "funding_claim_without_funding_support": "(?:raised|funding round|finanzierungsrunde|levée de fonds|ronda de financiación)",
}

QUERIES: dict[str, Query] = {
    "q_s02_cache_freshness": Query(
        ("SELECT user_id % 40 AS symbol, CAST(max(ts) AS DATE) AS latest, CAST(max(CASE WHEN event_type <> 'view' THEN ts END) AS DATE) AS fetched FROM events GROUP BY user_id % 40",) * 2,
        (stage(age=("datediff(DATE '2024-01-31', latest)", "datediff('day', latest, DATE '2024-01-31')"), fetch_age=("datediff(DATE '2024-01-31', fetched)", "datediff('day', fetched, DATE '2024-01-31')")), stage(status="CASE WHEN age < 0 THEN 'invalid' WHEN fetch_age = 0 AND age <= 7 THEN 'same_day' WHEN age <= 3 AND fetch_age <= 3 THEN 'fallback_eligible' ELSE 'stale' END")),
        ("symbol", "status"), tables=("events",),
    ),
    "q_s05_source_priority": Query(
        "SELECT 1 AS priority, 'primary' AS source, o_custkey AS code, CAST(o_orderdate AS DATE) AS dt, o_totalprice AS px FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 2, 'fallback', o_custkey, CAST(o_orderdate AS DATE), o_totalprice FROM orders",
        (stage(rk="row_number() OVER (PARTITION BY code, dt ORDER BY priority, px)"),), ("code", "dt", "source", "px"), "rk = 1",
    ),
    "q_s01_normalise_bars": Query(
        "SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS ingest_seq, CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR(30)) END AS raw_close FROM orders",
        (stage(close="try_cast(raw_close AS DOUBLE)"), stage(where="close IS NOT NULL"), stage(rk="row_number() OVER (PARTITION BY symbol, dt ORDER BY ingest_seq DESC)"), stage(where="rk = 1"), stage(back="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)")),
        ("symbol", "dt", "close"), "back <= 120",
    ),
    "q_s08_blocks": Query("SELECT event_id, event_type, props FROM events", (stage(k=("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)")), stage(block="CASE WHEN k < 30 THEN 'concept' WHEN k < 60 THEN 'industry' ELSE 'region' END")), final="SELECT block, event_type, count(*) AS members, CAST(min(k) AS BIGINT) AS low, CAST(max(k) AS BIGINT) AS high FROM t GROUP BY block, event_type", tables=("events",)),
    "q_s24_adapters": Query(("SELECT 'announcement' AS origin, doc_id AS id, 98 AS credit, substr(text, 1, 40) AS title FROM documents WHERE has(text, policy) UNION ALL SELECT 'news', page_id, 72, url FROM pages WHERE contains(url, 'www.') UNION ALL SELECT 'chat', conv_id, 30, substr(text, 1, 40) FROM conversations WHERE role = 'user'",) * 2, (), ("origin", "id", "credit", "title"), tables=("documents", "pages", "conversations")),
    "q_s35_note_scan": Query(
        # notes: a text with its fields as front matter
        "SELECT doc_id, concat('---', chr(10), 'lang: ', coalesce(lang, ''), chr(10), 'source: ', coalesce(source, ''), chr(10), '---', chr(10), coalesce(text, '')) AS note FROM documents",
        (stage(front=first_re("note", "^---\n((?:[a-z]+: [^\n]*\n)*)---\n")), stage(note_lang=first_re("front", "lang: ([^\n]*)"), note_source=first_re("front", "source: ([^\n]*)"), body="substr(note, length(front) + 9)"), stage(body_sha=sha256("body"))),
        ("doc_id", "note_lang", "note_source", "CAST(length(body) AS BIGINT) AS body_chars", "body_sha"), tables=DOCS,
    ),
    "q_b07_repair_chain": Query(
        tuple(
            f"""WITH b AS ({BARS}), g AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY dt), 0) AS ratio FROM b),
f AS (SELECT *, coalesce(sum(CASE WHEN abs(ratio - 1) > 0.25 THEN ln(ratio) ELSE 0 END) OVER (PARTITION BY symbol ORDER BY dt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lf FROM g)
SELECT symbol, {end} AS dt, count(*) AS days, sum(CASE WHEN abs(ratio - 1) > 0.25 THEN 1 ELSE 0 END) AS gaps, round(max(lf), 6) AS top_log_factor FROM f GROUP BY symbol, {end}"""
            for end in FRIDAY
        ),
        (), ("symbol", "dt", "days", "CAST(gaps AS BIGINT) AS gaps", "top_log_factor", "CASE WHEN gaps > 0 THEN 'gap_ratio' ELSE 'none' END AS lineage"),
    ),
    # the last two highs and lows of the swing path, the channel and the level, read together; the trend itself stays as it is
    "q_j15_path_text": judged(
        (
            *tr.JUDGMENT,
            *st.swings("low", 3, 3, "l"),
            *st.swings("high", 3, 3, "h"),
            # a swing is known three bars later
            stage(_l=f"CASE WHEN lag(l_low, 3) {PREV} THEN lag(low, 3) {PREV} END", _h=f"CASE WHEN lag(h_high, 3) {PREV} THEN lag(high, 3) {PREV} END"),
            stage(_nl=f"CAST(count(_l) {_SO_FAR} AS BIGINT)", _nh=f"CAST(count(_h) {_SO_FAR} AS BIGINT)"),
            stage(
                last_low="max(_l) OVER (PARTITION BY symbol, _nl)", last_high="max(_h) OVER (PARTITION BY symbol, _nh)",
                _pl=(f"last(_l, true) {_BEFORE_NOW}", f"last_value(_l IGNORE NULLS) {_BEFORE_NOW}"), _ph=(f"last(_h, true) {_BEFORE_NOW}", f"last_value(_h IGNORE NULLS) {_BEFORE_NOW}"),
            ),
            stage(prior_low="max(CASE WHEN _l IS NOT NULL THEN _pl END) OVER (PARTITION BY symbol, _nl)", prior_high="max(CASE WHEN _h IS NOT NULL THEN _ph END) OVER (PARTITION BY symbol, _nh)"),
            stage(
                lows="CASE WHEN _nl < 2 THEN 'unknown' WHEN last_low > prior_low * 1.01 THEN 'higher' WHEN last_low < prior_low * 0.99 THEN 'lower' ELSE 'flat' END",
                highs="CASE WHEN _nh < 2 THEN 'unknown' WHEN last_high > prior_high * 1.01 THEN 'higher' WHEN last_high < prior_high * 0.99 THEN 'lower' ELSE 'flat' END",
            ),
            stage(
                path="""CASE WHEN lows = 'unknown' OR highs = 'unknown' THEN 'too few swings' WHEN lows = 'higher' AND highs = 'higher' THEN 'rising swings' WHEN lows = 'lower' AND highs = 'lower' THEN 'falling swings'
 WHEN lows = 'higher' AND highs = 'lower' THEN 'narrowing swings' WHEN lows = 'lower' AND highs = 'higher' THEN 'widening swings' ELSE 'level swings' END""",
                agrees="""CASE WHEN judgment IN ('strong_up', 'weak_up') AND (lows = 'lower' OR close < last_low) THEN 'path weakens the trend'
 WHEN judgment IN ('down', 'invalid') AND (highs = 'higher' OR close > last_high) THEN 'path repairs the trend' ELSE 'path fits the trend' END""",
            ),
        ),
        "concat_ws('; ', path, CASE WHEN channel <> 'none' THEN concat('within a ', replace(channel, '_', ' ')) END, agrees, concat('judged ', judgment)) AS reading",
    ),
    "q_t08_structure_summary": judged((*tr.TARGET,), "CASE WHEN _neck IS NULL THEN 'levels' WHEN converged THEN 'pattern_and_fib' ELSE 'pattern' END AS method", "CASE WHEN daily_trend = 'ranging' THEN 'neutral' WHEN (daily_trend = 'up') = bull THEN 'aligned' ELSE 'opposed' END AS alignment"),
    "q_v19_sector_risks": Query("SELECT s.s_suppkey, n.n_regionkey, r.risk FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN (SELECT 0 AS k, 'currency' AS risk UNION ALL SELECT 1, 'policy' UNION ALL SELECT 2, 'supply' UNION ALL SELECT 3, 'demand' UNION ALL SELECT 4, 'energy') r ON r.k = n.n_regionkey", (), ("s_suppkey", "n_regionkey", "risk"), tables=("supplier", "nation")),
    "q_q12_topic_quota": Query(
        POSTS, (*SCORE, stage(h=sha256("content")), stage(best="row_number() OVER (PARTITION BY h ORDER BY quality DESC, seq)"), stage(where="best = 1"), stage(bucket="CASE WHEN has(content, policy) THEN 'policy' WHEN contains(content, ' | ') THEN 'table' WHEN contains(content, '@') THEN 'contact' WHEN contains(content, '!!') THEN 'heat' ELSE 'other' END"), stage(in_bucket="row_number() OVER (PARTITION BY source, bucket ORDER BY quality DESC, seq)"), stage(where="in_bucket <= 25"), stage(pick="row_number() OVER (PARTITION BY source ORDER BY CASE WHEN in_bucket = 1 THEN 0 ELSE 1 END, quality DESC, seq)")),
        ("seq", "source", "bucket", "CAST(pick AS BIGINT) AS pick"), "pick <= 25", tables=DOCS,
    ),
    "q_q15_category_pick": Query(
        PAGE_ROWS, (*CANONICAL, stage(fp=sha256("html")), stage(r1="row_number() OVER (PARTITION BY coalesce(canonical, fp) ORDER BY source_credit DESC, page_id)"), stage(where="r1 = 1"), stage(r2="row_number() OVER (PARTITION BY fp ORDER BY source_credit DESC, page_id)"), stage(where="r2 = 1"), stage(in_type="row_number() OVER (PARTITION BY source_type ORDER BY source_credit DESC, page_id)")),
        ("page_id", "source_type", "source_credit"), "in_type <= 5", tables=PAGES,
    ),
    "q_d14_redundant_units": Query(
        # a unit is redundant if a longer one of its document has the same numbers and half of the words
        tuple(
            f"""WITH u AS (SELECT doc_id, pos, length(sentence) AS chars, {numbers} AS num_key, {words} AS w FROM ({SENTENCES[k]}) q WHERE {has}),
j AS (SELECT a.doc_id, a.pos, b.pos AS kept_pos, {both_} AS common, {size}(a.w) AS na, {size}(b.w) AS nb FROM u a JOIN u b
  ON a.doc_id = b.doc_id AND a.num_key = b.num_key AND (b.chars > a.chars OR (b.chars = a.chars AND b.pos < a.pos)))
SELECT u.doc_id, u.pos, u.num_key, min(CASE WHEN 2 * common >= na + nb - common THEN kept_pos END) AS kept_pos FROM u LEFT JOIN j ON u.doc_id = j.doc_id AND u.pos = j.pos GROUP BY u.doc_id, u.pos, u.num_key"""
            for k, numbers, words, has, both_, size in (
                (0, "array_join(array_sort(array_distinct(regexp_extract_all(sentence, '[0-9]+', 0))), ' ')", "array_distinct(split(lower(sentence), ' +'))", "sentence RLIKE '[0-9]'", "size(array_intersect(a.w, b.w))", "size"),
                (1, "array_to_string(list_sort(list_distinct(regexp_extract_all(sentence, '[0-9]+'))), ' ')", "list_distinct(regexp_split_to_array(lower(sentence), ' +'))", "regexp_matches(sentence, '[0-9]')", "len(list_intersect(a.w, b.w))", "len"),
            )
        ),
        (), ("doc_id", "CAST(pos AS BIGINT) AS pos", "num_key", "kept_pos IS NOT NULL AS redundant"), tables=DOCS,
    ),
    "q_c03_body_claims": Query(LINES, (*HEADS, stage(where="NOT is_head AND length(line) >= 30 AND heading IS NOT NULL"), stage(in_head="row_number() OVER (PARTITION BY doc_id, section ORDER BY pos)"), stage(where="in_head <= 3"), stage(n="row_number() OVER (PARTITION BY doc_id ORDER BY pos)")), ("doc_id", "CAST(pos AS BIGINT) AS pos", "heading", "CAST(n AS BIGINT) AS n"), "n <= 8", tables=DOCS),
    "q_c06_pair_score": Query(
        CLAIM_SOURCE, CLAIMS,
        final=tuple(f"{x} SELECT lang, topics, specific, generic, CAST(day AS BIGINT) AS day, claim_tier, CAST(max(score) AS BIGINT) AS best_score FROM p WHERE score > 0 GROUP BY lang, topics, specific, generic, day, claim_tier" for x in SCORED),
        tables=DOCS,
    ),
    # what a prompt may show: the first claims of each outcome, cut to 200 characters
    "q_c08_plan_summary": Query(
        CLAIM_SOURCE, CLAIMS,
        final=tuple(
            f"""{x} SELECT lang, action, CAST(rk AS BIGINT) AS rk, doc_id, confidence, substr(trim(text), 1, 200) AS claim FROM (
SELECT *, row_number() OVER (PARTITION BY lang, action ORDER BY confidence DESC, doc_id) AS rk FROM w) y
WHERE rk <= CASE action WHEN 'verified' THEN 6 ELSE 4 END"""
            for x in SCORED
        ),
        tables=DOCS,
    ),
    "q_x03_sections": Query(LINES, HEADS, final="SELECT doc_id, section, max(heading) AS heading, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM t GROUP BY doc_id, section", tables=DOCS),
    "q_x05_observations": sentences((stage(kind="CASE WHEN has(sentence, risk) THEN 'risk' WHEN has(sentence, plan) OR has(sentence, policy) THEN 'plan' WHEN has(sentence, structure) THEN 'structure' END", rank_score="terms(sentence, signal)"), stage(where="kind IS NOT NULL"), stage(rk="row_number() OVER (PARTITION BY doc_id, kind ORDER BY rank_score DESC, pos)")), "kind", where="rk <= 3"),
    "q_x09_evidence_pack": Query(SENTENCES, (stage(usage="CASE WHEN has(sentence, policy) THEN 'legal' WHEN contains(sentence, '@') THEN 'contact' WHEN contains(sentence, '|') THEN 'table' WHEN has(sentence, driver) THEN 'narrative' END"), stage(where="usage IS NOT NULL"), stage(n="row_number() OVER (PARTITION BY doc_id, usage ORDER BY pos)"), stage(cap="CASE usage WHEN 'narrative' THEN 3 WHEN 'table' THEN 2 ELSE 1 END"), stage(where="n <= cap"), stage(block_id="concat(usage, '-', CAST(n AS VARCHAR(9)))", slot="row_number() OVER (PARTITION BY doc_id ORDER BY CASE usage WHEN 'legal' THEN 0 WHEN 'contact' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, pos)")), ("doc_id", "block_id", "CAST(slot AS BIGINT) AS slot"), "slot <= 6", tables=DOCS),
    # the last sentence as a summary: its numbers and names must come from the sentences before
    "q_x15_fidelity": Query(
        tuple(
            f"""WITH s AS ({SENTENCES[k]}), m AS (SELECT doc_id, max(pos) AS last_pos FROM s GROUP BY doc_id),
c AS (SELECT s.doc_id, s.pos, s.sentence, s.pos = m.last_pos AS summary FROM s JOIN m ON s.doc_id = m.doc_id),
n AS (SELECT doc_id, pos, summary, {numbers}),
b AS (SELECT doc_id, num, CAST(num AS DOUBLE) AS v, lag(CAST(num AS DOUBLE)) OVER (PARTITION BY doc_id ORDER BY pos, k) AS prev FROM n WHERE NOT summary),
q AS (SELECT DISTINCT doc_id, num, CAST(num AS DOUBLE) AS v FROM n WHERE summary),
g AS (SELECT q.doc_id, q.num AS item, max(CASE WHEN q.num = b.num THEN 3 WHEN b.v >= 10000 AND abs(q.v - b.v) <= 0.01 * b.v THEN 2 WHEN b.prev > 0 AND abs(q.v - (b.v / b.prev - 1) * 100) <= 0.5 THEN 1 ELSE 0 END) AS how
  FROM q LEFT JOIN b ON q.doc_id = b.doc_id GROUP BY q.doc_id, q.num),
x AS (SELECT doc_id, {names.format('[a-z,;] ')} WHERE summary),
y AS (SELECT doc_id, {names.format('')} WHERE NOT summary),
e AS (SELECT DISTINCT x.doc_id, x.name AS item, CASE WHEN y.name IS NULL THEN 0 ELSE 3 END AS how FROM x LEFT JOIN (SELECT DISTINCT doc_id, name FROM y) y ON x.doc_id = y.doc_id AND x.name = y.name)
SELECT doc_id, 'number' AS kind, item, how FROM g UNION ALL SELECT doc_id, 'name', item, how FROM e"""
            for k, numbers, names in (
                (0, "posexplode(regexp_extract_all(sentence, r'[0-9]+(?:[.][0-9]+)?', 0)) AS (k, num) FROM c", "explode(regexp_extract_all(sentence, r'{}([A-Z][A-Za-z]+)', 1)) AS name FROM c"),
                (1, "unnest(range(len(nums))) AS k, unnest(nums) AS num FROM (SELECT *, regexp_extract_all(sentence, '[0-9]+(?:[.][0-9]+)?') AS nums FROM c) z", "unnest(regexp_extract_all(sentence, '{}([A-Z][A-Za-z]+)', 1)) AS name FROM c"),
            )
        ),
        (), ("doc_id", "kind", "item", "CASE how WHEN 3 THEN 'stated' WHEN 2 THEN 'rounded' WHEN 1 THEN 'growth' ELSE 'ungrounded' END AS grounding"), tables=DOCS,
    ),
    "q_x18_risk_dedupe": sentences((stage(risk="CASE WHEN has(sentence, abuse) THEN 'conduct' WHEN has(sentence, secret) THEN 'leak' WHEN has(sentence, risk) THEN 'loss' END"), stage(where="risk IS NOT NULL"), stage(r1="row_number() OVER (PARTITION BY doc_id, risk ORDER BY pos)"), stage(where="r1 = 1"), stage(ck=replace_re("lower(sentence)", "[^a-z]+", "")), stage(r2="row_number() OVER (PARTITION BY doc_id, CASE WHEN length(ck) >= 20 THEN substr(ck, 1, 40) ELSE risk END ORDER BY pos)")), "risk", where="r2 = 1"),
    "q_x19_explanations": sentences((stage(reason="terms(sentence, mechanism) + terms(sentence, logic)"), stage(where="reason > 1"), stage(rk="row_number() OVER (PARTITION BY doc_id ORDER BY reason DESC, pos)")), "reason", where="rk <= 3"),
    "q_x22_statement_lines": Query(LINES, (stage(nums=count_re("line", "[0-9]+(?:[.][0-9]+)?")), stage(where="nums >= 2"), stage(first_num=first_re("line", "([0-9]+(?:[.][0-9]+)?)"), unit_rank="CASE WHEN contains(line, '%') THEN 0 WHEN contains(line, '=') THEN 1 ELSE 2 END"), stage(rk="row_number() OVER (PARTITION BY doc_id ORDER BY unit_rank, pos)")), ("doc_id", "CAST(pos AS BIGINT) AS pos", "first_num"), "rk = 1", tables=DOCS),
    "q_x23_largest_amount": Query("SELECT doc_id, text FROM documents", (stage(nums=all_re("text", "[0-9]+")), stage(largest=("array_max(transform(nums, x -> CAST(x AS DOUBLE)))", "list_max(list_transform(nums, lambda x: CAST(x AS DOUBLE)))"))), ("doc_id", "largest"), "largest IS NOT NULL", tables=DOCS),
    "q_e10_preview": Query(PAGE_ROWS, (*CANONICAL, stage(k="coalesce(canonical, url)"), stage(rk="row_number() OVER (PARTITION BY k ORDER BY page_id)"), stage(where="rk = 1"), stage(n="row_number() OVER (PARTITION BY domain ORDER BY page_id)")), ("page_id", "domain"), "n <= 10", tables=PAGES),
    "q_g02_section_candidates": Query(LINES, (*HEADS, stage(where="is_head"), stage(next_pos="lead(pos) OVER (PARTITION BY doc_id ORDER BY pos)")), ("doc_id", "heading", "CAST(pos AS BIGINT) AS pos", "CAST(coalesce(next_pos - pos, 20) AS BIGINT) AS span"), tables=DOCS),
    "q_g04_unit_roles": sentences((stage(claim="has(sentence, claim)", evidence=match_re("sentence", "[0-9]"), mechanism="has(sentence, mechanism)", driver="has(sentence, driver)", risk="has(sentence, risk)"), stage(roles="CAST(claim AS INT) + CAST(evidence AS INT) + CAST(mechanism AS INT) + CAST(driver AS INT) + CAST(risk AS INT)")), "claim", "evidence", "mechanism", "driver", "risk", "roles"),
    "q_g07_digest_items": Query(POSTS, (*SCORE, stage(where="action <> 'discard'"), stage(note_id=both("substr({0}, 1, 16)", sha256("content")))), ("seq", "note_id", "source", "published", "round(quality, 4) AS quality"), tables=DOCS),
    "q_a04_pack_select": Query("SELECT doc_id, source, text, doc_id % 2 = 0 AS is_v2, doc_id - doc_id % 2 AS card_id FROM documents", (stage(has_v2="max(CASE WHEN is_v2 THEN 1 ELSE 0 END) OVER (PARTITION BY card_id)"), stage(state="CASE WHEN is_v2 THEN 'v2' WHEN has_v2 = 1 THEN 'covered' WHEN length(text) < 80 THEN 'invalid' ELSE 'actionable' END")), final="SELECT source, state, count(*) AS cards FROM t GROUP BY source, state", tables=DOCS),
    "q_l03_report_rules": Query(
        "SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents",
        (stage(**{code: (match_re("low", p) if isinstance(p, str) else p[0]) for code, p in REPORT_RULES.items()}),),
        final=(
            "SELECT doc_id, explode(array_compact(array(" + ", ".join(f"CASE WHEN {code} THEN '{code}' END" for code in REPORT_RULES) + "))) AS code FROM t",
            " UNION ALL ".join(f"SELECT doc_id, '{code}' AS code FROM t WHERE {code}" for code in REPORT_RULES),
        ),
        tables=DOCS,
    ),
    "q_r01_assembly": Query(POSTS, (*SCORE, stage(where="action <> 'discard'"), stage(rk="row_number() OVER (PARTITION BY source ORDER BY quality DESC, seq)"), stage(where="rk <= 5")), final=("SELECT source, concat('# ', source, ': ', array_join(transform(array_sort(collect_list(struct(rk, seq))), x -> CAST(x.seq AS STRING)), ', ')) AS section FROM t GROUP BY source", "SELECT source, concat('# ', source, ': ', string_agg(CAST(seq AS VARCHAR), ', ' ORDER BY rk)) AS section FROM t GROUP BY source"), tables=DOCS),
    "q_r06_executive_view": triggered(
        (*tr.TRIGGERS, stage(rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)")),
        "trend_stage", "judgment", "health_grade", "execution", "action",
        where="rk = 1",
    ),
}
