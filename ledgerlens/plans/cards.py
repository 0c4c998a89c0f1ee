"""Queries that assemble cards and packs from filing text and peers (X08 X10 X12 X16 X26 X27 E06 E09 G06 A01 D11 F07 P12 S06 S32) and their SQL."""

from __future__ import annotations

from ..functions.lexicon import METRIC_GROUPS
from ..functions.text import all_re, both, count_re, first_re, match_re, sha256
from ..operators import indicators as ind
from ..sources.tables import BARS, INDEX_BARS
from .more import HEADS, LINES, sentences
from .scoring import LI, QUOTES, VALUED, hits
from .stages import Query, stage
from .texts import DOCS, POSTS, SCORE, SENTENCES, dense_refs

NUMBER = "[0-9]+(?:[.][0-9]+)?"

#: A marker with up to 80 characters of its sentence on both sides. No match leaves its sentence, so only sentences with a marker are searched for it.
MARKER = "[Ll]icen[cs]e|password|token|@"
SNIPPET = f"[^.\\n]{{0,80}}(?:{MARKER})[^.\\n]{{0,80}}"
_MARKED = f"filter(split(text, r'[.\\n]'), x -> x RLIKE r'{MARKER}')"

#: Card families by the marks of a sentence, in order of precedence.
FAMILY = "CASE WHEN has(sentence, policy) THEN 'legal' WHEN contains(sentence, '@') THEN 'contact' WHEN contains(sentence, '|') THEN 'table' WHEN has(sentence, driver) THEN 'driver' ELSE 'context' END"

QUERIES: dict[str, Query] = {
    "q_s06_index_chain": Query(
        f"SELECT 1 AS priority, 'cache' AS source, symbol, dt, close FROM ({INDEX_BARS}) a WHERE volume % 3 = 0 UNION ALL SELECT 2, 'primary', symbol, dt, close FROM ({INDEX_BARS}) b WHERE volume % 2 = 0 UNION ALL SELECT 3, 'stale_cache', symbol, dt, close FROM ({INDEX_BARS}) c",
        (stage(rk="row_number() OVER (PARTITION BY symbol, dt ORDER BY priority)"),), ("symbol", "dt", "source", "close"), "rk = 1",
    ),
    "q_s32_report_match": Query(POSTS, (stage(year="year(published)", keyword="has(content, annual_report) OR has(content, policy)"), stage(where="keyword"), stage(rk="row_number() OVER (PARTITION BY lang, source, year ORDER BY published DESC, seq)")), ("seq", "lang", "source", "year"), "rk = 1", tables=DOCS),
    "q_p12_double_bottom": Query(
        BARS,
        (
            stage(back="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)"),
            stage(where="back <= 30"),
            stage(_b=f"lag(close) {ind.PREV}", _a=f"lead(close) {ind.PREV}"),
            stage(dip="coalesce(close < _b AND close < _a, false)"),
            stage(rk="CASE WHEN dip THEN row_number() OVER (PARTITION BY symbol, dip ORDER BY close, dt) END"),
            stage(d1="max(CASE WHEN rk = 1 THEN dt END) OVER (PARTITION BY symbol)", d2="max(CASE WHEN rk = 2 THEN dt END) OVER (PARTITION BY symbol)", w1="max(CASE WHEN rk = 1 THEN close END) OVER (PARTITION BY symbol)", w2="max(CASE WHEN rk = 2 THEN close END) OVER (PARTITION BY symbol)"),
        ),
        final="""SELECT symbol, max(w1) AS bottom1, max(w2) AS bottom2, max(CASE WHEN dt BETWEEN d1 AND d2 THEN close END) AS peak,
coalesce(max(d1) < max(d2) AND max(w2) <= max(w1) * 1.03 AND max(CASE WHEN dt BETWEEN d1 AND d2 THEN close END) >= 1.03 * max(w2), false) AS double_bottom FROM t GROUP BY symbol""",
    ),
    "q_f07_competitor_table": Query(QUOTES, (*VALUED, stage(rk="row_number() OVER (PARTITION BY industry ORDER BY mcap DESC, code)")), ("industry", "CAST(rk AS BIGINT) AS rk", "code", "round(mcap, 4) AS mcap", "round(fwd_pe, 4) AS fwd_pe", "round(ps, 4) AS ps"), "rk <= 8", tables=LI),
    "q_x12_financial_metrics": Query(
        SENTENCES,
        (
            stage(found="concat_ws(',', " + ", ".join(f"CASE WHEN has(sentence, {g}) THEN '{g[2:]}' END" for g in METRIC_GROUPS) + ")"),
            stage(where="found <> ''"),
            stage(raw=first_re("sentence", f"({NUMBER})"), unit=first_re("lower(sentence)", f"{NUMBER} ?(%|million|mio|billion|mrd|milliard|thousand|tsd)")),
        ),
        final=tuple(
            f"SELECT doc_id, metric_group, raw, unit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, metric_group ORDER BY CASE WHEN raw = '' THEN 1 ELSE 0 END, pos) AS rk FROM (SELECT doc_id, pos, raw, unit, {e} AS metric_group FROM t) x) y WHERE rk = 1"
            for e in ("explode(split(found, ','))", "unnest(string_split(found, ','))")
        ),
        tables=DOCS,
    ),
    "q_x27_snippets": Query(
        tuple(
            f"SELECT doc_id, trim(s) AS snippet FROM (SELECT doc_id, {e} AS s FROM documents) x"
            for e in (f"explode(array_distinct(flatten(transform({_MARKED}, x -> regexp_extract_all(x, r'{SNIPPET}', 0)))))", f"unnest(list_distinct(regexp_extract_all(text, '{SNIPPET}')))")
        ),
        (stage(snippet_sha=sha256("snippet")),), ("doc_id", "CAST(length(snippet) AS BIGINT) AS chars", "snippet_sha"), "length(snippet) >= 16", tables=DOCS,
    ),
    "q_e09_display_cards": Query(
        SENTENCES, (stage(family=FAMILY), stage(where="family <> 'context'"), stage(rk="row_number() OVER (PARTITION BY doc_id, family ORDER BY length(sentence) DESC, pos)")),
        final=(
            f"SELECT x.doc_id, x.family, r.ref, x.chars FROM t x JOIN ({dense_refs('doc_id')}) r ON x.source = r.source AND x.doc_id = r.doc_id WHERE x.rk = 1",
            "SELECT doc_id, family, CAST(ref AS BIGINT) AS ref, CAST(length(sentence) AS BIGINT) AS chars FROM (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS ref FROM t) x WHERE rk = 1",
        ),
        tables=DOCS, once=("doc_id", "source", "family", "rk", "CAST(length(sentence) AS BIGINT) AS chars"),
    ),
    "q_g06_digest_cards": sentences((stage(signal="terms(sentence, signal)", noise=count_re("sentence", "[!#$%&*|]")), stage(score="CAST(least(60, signal * 15) + 8 - least(40, noise * 2) AS INT)"), stage(where="noise < 20"), stage(rk="row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos)"), stage(n_units="count(*) OVER (PARTITION BY doc_id)"), stage(cap="CASE WHEN n_units <= 10 THEN 3 WHEN n_units <= 40 THEN 5 ELSE 8 END")), "score", "CAST(rk AS BIGINT) AS rk", where="rk <= cap"),
    "q_a01_narrative_cards": Query(
        SENTENCES,
        (stage(family=FAMILY, noise="contains(sentence, '!!') OR length(sentence) > 600"), stage(bad="max(CASE WHEN noise THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id)"), stage(where="bad = 0"), stage(_new="CASE WHEN family = lag(family) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END"), stage(run="CAST(sum(_new) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)")),
        final="SELECT doc_id, run, family, units, chars FROM (SELECT doc_id, run, min(family) AS family, count(*) AS units, CAST(sum(length(sentence)) AS BIGINT) AS chars, row_number() OVER (PARTITION BY doc_id, min(family) ORDER BY run) AS rk FROM t GROUP BY doc_id, run) x WHERE rk <= 3 AND family <> 'context'", tables=DOCS,
    ),
}
