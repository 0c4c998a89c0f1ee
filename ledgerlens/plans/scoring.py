"""Queries for scoring, valuation, risk, fund flow and peers (V, F) and their SQL."""

from __future__ import annotations

from ..operators import indicators as ind
from ..operators import trend as tr
from ..sources.tables import FLOW
from .market import triggered
from .stages import Query, Stage, last, stage

#: Parameters of the keyword operators: words of both moods in the languages of the given corpus.
BULL = ("buy", "bullish", "rally", "upside", "outperform", "growth", "strong", "good", "kaufen", "stark", "chancen", "achat", "hausse", "bon ", "compra", "alza")
BEAR = ("sell", "bearish", "crash", "downside", "loss", "worthless", "stupid", "disgusting", "verkaufen", "verlust", "schwach", "vente", "baisse", "perte", "venta", "pérdida")


def hits(text: str, words: tuple[str, ...]) -> str:
    """How many different words the text contains."""
    return "(" + " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


SENTIMENT: tuple[Stage, ...] = (
    stage(_t="lower(concat(coalesce(title, ''), ' ', coalesce(content, '')))"),
    stage(bull_hits=hits("_t", BULL), bear_hits=hits("_t", BEAR)),
    stage(sentiment="CASE WHEN bull_hits > bear_hits THEN 'bull' WHEN bear_hits > bull_hits THEN 'bear' ELSE 'neutral' END"),
)
POSTS = "SELECT doc_id AS seq, source AS symbol, substr(text, 1, 60) AS title, text AS content, (doc_id * 7) % 100 AS likes, (doc_id * 13) % 40 AS comments FROM documents"

#: One row of market measures per supplier: a stock with quote, consensus and peers derived from its parts and orders.
QUOTES = """
SELECT s.s_suppkey AS code, s.s_nationkey AS industry, avg(l.l_extendedprice / l.l_quantity) AS price,
  sum(l.l_extendedprice) / 100000 AS mcap, sum(l.l_extendedprice) / 100000 * (0.5 + 0.07 * (s.s_suppkey % 10)) AS float_mcap,
  CASE WHEN s.s_suppkey % 11 = 0 THEN -1.0 ELSE avg(l.l_discount) * 100 END AS eps_this,
  CASE WHEN s.s_suppkey % 13 = 0 THEN NULL ELSE avg(l.l_tax) * 150 END AS eps_next,
  sum(l.l_extendedprice * (1 - l.l_discount)) / 100000 AS revenue, sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS returns_n, count(*) AS n
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_nationkey"""
#: The pillars' other inputs: each stock takes the last bar of its symbol, the posts of its source and its fund flow.
LAST_BAR = triggered(
    (
        *tr.TRIGGERS,
        *ind.bias(10),
        stage(
            rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)",
            month_pct=f"(close / nullif(lag(close, 21) {ind.PREV}, 0) - 1) * 100",
            turnover=f"avg(amount) {last(20)} / 100000000",
            below20="close < ma20",
        ),
    ),
    "CAST(substr(symbol, 1, 1) AS INT) - 1 AS slot", "health", "health_grade", "trend_stage", "judgment", "action", "macd", "rsi", "close", "ma20",
    "bias5_high OR bias10_high AS overheated", "month_pct", "turnover", "below20",
    where="rk = 1",
)
MOOD = Query(
    POSTS, SENTIMENT,
    final="SELECT symbol, count(*) AS posts, CAST(round(100.0 * count(CASE WHEN sentiment = 'bull' THEN 1 END) / count(*), 1) AS DOUBLE) AS bull_pct, CAST(round(100.0 * count(CASE WHEN sentiment = 'bear' THEN 1 END) / count(*), 1) AS DOUBLE) AS bear_pct FROM t GROUP BY symbol",
    tables=("documents",),
)
FLOW_TOP: tuple[Stage, ...] = (
    stage(where="main_net <> 0 AND dt IS NOT NULL"),
    stage(rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)"),
    stage(where="rk <= 5"),
)
#: In the flow's own unit, of which the reference thresholds count ten thousand.
FIVE_DAYS = Query(FLOW, FLOW_TOP, final="SELECT symbol, sum(main_net) * 100 AS main5 FROM t GROUP BY symbol", tables=("events",))
STOCKS = f"""SELECT q.*, b.health, b.health_grade, b.trend_stage, b.judgment, b.action, b.rsi, b.macd, b.close, b.ma20, b.overheated, b.month_pct, b.turnover, b.below20,
  coalesce(m.bull_pct, 0) AS bull_pct, f.main5
FROM ({QUOTES}) q LEFT JOIN last_bar b ON b.slot = q.code % 5 LEFT JOIN mood m ON m.symbol = concat('src', CAST(q.code % 20 AS VARCHAR(9))) LEFT JOIN five_days f ON f.symbol = q.code % 20"""

VALUED: tuple[Stage, ...] = (
    stage(fwd_pe="price / nullif(eps_this, 0)", growth="CASE WHEN eps_this <> 0 THEN (eps_next / eps_this - 1) * 100 END", ps="mcap / nullif(revenue, 0)"),
    stage(peg="fwd_pe / nullif(growth, 0)", industry_pe="avg(CASE WHEN fwd_pe > 0 THEN fwd_pe END) OVER (PARTITION BY industry)"),
    stage(pe_ratio="fwd_pe / nullif(industry_pe, 0)"),
)
#: Trend health in tens, at most 4 in a downtrend; without it, points of the oscillators and the side of the average.
TECHNICAL = stage(
    technical_score="""CAST(CASE WHEN health IS NOT NULL THEN
  CASE WHEN trend_stage IN ('broken', 'weakening') THEN least(4.0, round(health / 10.0, 1)) ELSE round(health / 10.0, 1) END
 ELSE least(10.0, greatest(0.0, 5.0 + CASE WHEN rsi BETWEEN 45 AND 65 THEN 1.5 WHEN rsi > 70 OR rsi < 30 THEN -1.5 ELSE 0 END
  + CASE WHEN macd > 0 THEN 1.0 WHEN macd <= 0 THEN -1.0 ELSE 0 END + CASE WHEN close > ma20 THEN 1.0 WHEN close <= ma20 THEN -1.0 ELSE 0 END)) END AS DOUBLE)"""
)
PILLARS: tuple[Stage, ...] = (
    *VALUED,
    TECHNICAL,
    stage(
        valuation_score="""CAST(round(CASE
 WHEN fwd_pe <= 0 THEN CASE WHEN ps > 0 AND ps < 3 THEN 10.0 WHEN ps > 0 AND ps < 5 THEN 8.0 WHEN ps > 0 AND ps < 8 THEN 6.0
  WHEN ps > 0 AND ps < 12 THEN 4.0 WHEN ps > 0 AND ps < 20 THEN 2.0 WHEN ps > 0 THEN 0.0 ELSE 1.0 END
 WHEN pe_ratio <= 1.0 THEN 10.0 WHEN pe_ratio >= 2.5 THEN 0.0 WHEN pe_ratio IS NOT NULL THEN 10.0 * (2.5 - pe_ratio) / 1.5
 WHEN fwd_pe < 30 THEN 9.0 WHEN fwd_pe < 50 THEN 7.0 WHEN fwd_pe < 80 THEN 5.0 WHEN fwd_pe < 120 THEN 3.0 WHEN fwd_pe IS NOT NULL THEN 1.0 ELSE 5.0 END, 1) AS DOUBLE)""",
        fundamental_score="CAST(CASE WHEN growth IS NULL THEN 5 WHEN growth > 50 THEN 10 WHEN growth > 30 THEN 8 WHEN growth > 10 THEN 6 WHEN growth > 0 THEN 4 ELSE 2 END AS DOUBLE)",
        sentiment_score="CAST(CASE WHEN bull_pct > 80 THEN 8 WHEN bull_pct > 50 THEN 7 WHEN bull_pct > 30 THEN 5 ELSE 3 END AS DOUBLE)",
        flow_score="CAST(CASE WHEN main5 IS NULL THEN 5 WHEN main5 > 50000 THEN 9 WHEN main5 > 0 THEN 7 WHEN main5 > -30000 THEN 4 ELSE 2 END AS DOUBLE)",
    ),
    stage(total_score="CAST(round(0.30 * valuation_score + 0.25 * technical_score + 0.20 * sentiment_score + 0.15 * fundamental_score + 0.10 * flow_score, 1) AS DOUBLE)"),
)
EV: tuple[Stage, ...] = (
    *PILLARS,
    stage(
        target_high="fwd_pe * eps_next * 1.2", target_mid="fwd_pe * eps_next", target_low="fwd_pe * eps_next * 0.7",
        p_short="(technical_score * 0.6 + flow_score * 0.4) / 10", p_mid="(sentiment_score * 0.5 + fundamental_score * 0.5) / 10", p_long="valuation_score / 10",
    ),
    stage(up_short="target_high / nullif(price, 0) - 1", up_mid="target_mid / nullif(price, 0) - 1", down="greatest(0, 1 - target_low / nullif(price, 0))"),
    stage(ev="100 * (0.5 * (p_short * up_short - (1 - p_short) * down) + 0.3 * (p_mid * up_mid - (1 - p_mid) * down) + 0.2 * (p_long * up_mid - (1 - p_long) * down))"),
    stage(ev_label="CASE WHEN ev IS NULL THEN 'none' WHEN ev > 8 THEN 'strong_buy' WHEN ev > 3 THEN 'buy' WHEN ev > -3 THEN 'hold' WHEN ev > -8 THEN 'avoid' ELSE 'strong_avoid' END"),
)
#: The judgment's action decides first; without one the health and the stage do. Severe states win over overheated ones.
CONSTRAINT = stage(
    constraint_code="""CASE
 WHEN action = 'risk_control' AND judgment IN ('down', 'invalid') THEN 'severe_technical' WHEN action = 'risk_control' THEN 'risk_control'
 WHEN action = 'wait_for_entry' THEN 'wait_for_entry' WHEN action IN ('wait_for_confirmation', 'unavailable') THEN 'wait_for_confirmation'
 WHEN action IS NULL AND (trend_stage IN ('broken', 'weakening') OR health_grade = 'E' OR health < 30) THEN 'severe_technical'
 WHEN overheated THEN 'overheated' WHEN action IS NOT NULL THEN 'ok'
 WHEN health_grade = 'D' OR health < 45 THEN 'weak_trend' ELSE 'ok' END"""
)
RISK: tuple[Stage, ...] = (
    *EV,
    CONSTRAINT,
    stage(
        r_valuation="CASE WHEN industry_pe > 0 AND fwd_pe > 2 * industry_pe THEN 2.0 WHEN industry_pe IS NULL AND peg > 2 THEN 2.0 ELSE 0.0 END",
        r_month="CASE WHEN month_pct > 30 THEN 2.0 ELSE 0.0 END",
        r_crowd="CASE WHEN bull_pct > 80 THEN 1.5 ELSE 0.0 END",
        r_average="CASE WHEN below20 THEN 1.0 ELSE 0.0 END",
        r_liquidity="CASE WHEN turnover < 5 THEN 1.0 ELSE 0.0 END",
        r_entry="CASE constraint_code WHEN 'severe_technical' THEN 4.0 WHEN 'risk_control' THEN 2.0 WHEN 'wait_for_entry' THEN 2.0 WHEN 'overheated' THEN 1.5 WHEN 'weak_trend' THEN 2.0 ELSE 0.0 END",
    ),
    stage(risk_score="CAST(least(10.0, r_valuation + r_month + r_crowd + r_average + r_liquidity + r_entry) AS DOUBLE)"),
    stage(
        risk_band="CASE WHEN risk_score <= 2.5 THEN 'low' WHEN risk_score <= 5 THEN 'medium' WHEN risk_score <= 7.5 THEN 'elevated' WHEN risk_score <= 9 THEN 'high' ELSE 'very_high' END",
        final_label="""CASE WHEN ev_label NOT IN ('strong_buy', 'buy') THEN ev_label ELSE CASE constraint_code WHEN 'wait_for_entry' THEN 'buy_wait_for_entry'
 WHEN 'wait_for_confirmation' THEN 'buy_wait_for_confirmation' WHEN 'risk_control' THEN 'risk_control_first' WHEN 'overheated' THEN 'buy_do_not_chase'
 WHEN 'severe_technical' THEN 'risk_control_first' WHEN 'weak_trend' THEN 'buy_small_position' ELSE ev_label END END""",
    ),
)

SIGNALS = """
SELECT doc_id AS seq, source AS symbol, CASE doc_id % 5 WHEN 0 THEN 'dilution' WHEN 1 THEN 'lawsuit' WHEN 2 THEN 'delisting' WHEN 3 THEN 'pledge' ELSE 'unknown' END AS name,
  (doc_id * 37) % 101 AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'verified' WHEN doc_id % 3 = 1 THEN 'supported' ELSE 'unverified' END AS status FROM documents"""

DOCS = ("documents",)
LI = ("lineitem", "supplier")


def quotes(stages, *select: str, where=None) -> Query:
    return Query(QUOTES, tuple(stages), ("code", *select), where, tables=LI)


STOCK_TABLES = ("lineitem", "supplier")


def stocks(stages, *select: str, where=None) -> Query:
    """Quotes joined with the last bar, the mood and the flow of each stock."""
    return Query(STOCKS, tuple(stages), ("code", *select), where, tables=STOCK_TABLES, uses={"last_bar": LAST_BAR, "mood": MOOD, "five_days": FIVE_DAYS})


def r6(*cols: str) -> tuple[str, ...]:
    return tuple(f"round({c}, 6) AS {c}" for c in cols)


#: A peer's confidence falls with each measure that is missing, not positive or far from its industry.
PEER_CONFIDENCE: tuple[Stage, ...] = (
    *VALUED,
    stage(
        no_forecast="eps_next IS NULL",
        at_loss="eps_this IS NULL OR eps_this <= 0",
        far_off="coalesce(pe_ratio > 3 OR pe_ratio < 0.33, false)",
    ),
    stage(confidence="CAST(0.95 - CASE WHEN no_forecast THEN 0.20 ELSE 0 END - CASE WHEN at_loss THEN 0.20 ELSE 0 END - CASE WHEN far_off THEN 0.15 ELSE 0 END AS DOUBLE)"),
    stage(usage="CASE WHEN confidence >= 0.70 THEN 'claim' WHEN confidence >= 0.50 THEN 'context' ELSE 'drop' END"),
)

#: At most five members of each industry are peers; they and their measures travel as one small array per industry.
_MEASURES = ("price", "mcap", "eps_this", "eps_next", "revenue")
_SPARK_VALUES = ", ".join(f"'{m}', {m}, other.{m}" for m in _MEASURES)
PEER_ROWS = (
    f"""WITH q AS ({QUOTES}),
c AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY code) AS pos FROM q),
g AS (SELECT *, collect_list(CASE WHEN pos <= 5 THEN struct(code, {", ".join(_MEASURES)}) END) OVER (PARTITION BY industry) AS members FROM c),
p AS (SELECT g.*, posexplode(slice(array_sort(filter(members, m -> m.code <> g.code)), 1, 4)) AS (peer_rank, other) FROM g),
j AS (SELECT code, other.code AS peer, peer_rank, stack({len(_MEASURES)}, {_SPARK_VALUES}) AS (metric, target_value, peer_value) FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY code, metric ORDER BY peer_rank) AS rk FROM j WHERE target_value IS NOT NULL AND peer_value IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY metric, rk) AS pos FROM k WHERE rk <= 2)
SELECT * FROM l WHERE pos <= 8""",
    f"""WITH q AS ({QUOTES}),
m AS ({" UNION ALL ".join(f"SELECT code, industry, '{m}' AS metric, {m} AS v FROM q" for m in _MEASURES)}),
c AS (SELECT code, industry, row_number() OVER (PARTITION BY industry ORDER BY code) AS pos FROM q),
p AS (SELECT a.code, b.code AS peer, a.industry, row_number() OVER (PARTITION BY a.code ORDER BY b.code) AS peer_rank FROM c a JOIN c b ON a.industry = b.industry AND b.pos <= 5 AND a.code <> b.code),
j AS (SELECT p.code, p.peer, p.peer_rank, t.metric, t.v AS target_value, r.v AS peer_value FROM p JOIN m t ON t.code = p.code JOIN m r ON r.code = p.peer AND r.metric = t.metric WHERE t.v IS NOT NULL AND r.v IS NOT NULL AND p.peer_rank <= 4),
k AS (SELECT *, row_number() OVER (PARTITION BY code, metric ORDER BY peer_rank) AS rk FROM j),
l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY metric, rk) AS pos FROM k WHERE rk <= 2)
SELECT * FROM l WHERE pos <= 8""",
)

QUERIES: dict[str, Query] = {
    "q_v01_sentiment": Query(POSTS, SENTIMENT, ("seq", "bull_hits", "bear_hits", "sentiment"), tables=DOCS),
    "q_v02_sentiment_ratio": MOOD,
    "q_v03_technical_pillar": triggered((*tr.HEALTH, TECHNICAL), "technical_score"),
    "q_v04_pillars": stocks(PILLARS, *r6("valuation_score", "fundamental_score", "sentiment_score", "technical_score", "flow_score")),
    "q_v05_ev": stocks(EV, *r6("p_short", "p_mid", "p_long", "target_high", "target_low", "ev"), "ev_label"),
    "q_v06_total": stocks(PILLARS, *r6("total_score")),
    "q_v07_risk": stocks(RISK, "risk_score", "risk_band"),
    "q_v08_structured_signals": Query(
        SIGNALS,
        (
            stage(where="confidence >= 60 AND name <> 'unknown' AND status <> 'unverified'"),
            stage(_base="CASE name WHEN 'delisting' THEN 4.0 WHEN 'lawsuit' THEN 2.0 WHEN 'dilution' THEN 1.5 ELSE 1.0 END"),
            stage(effect="CAST(CASE WHEN status = 'verified' THEN _base ELSE round(_base * 0.5 * 2) / 2 END AS DOUBLE)"),
            stage(rk="row_number() OVER (PARTITION BY symbol, name ORDER BY effect DESC, confidence DESC, seq)"),
        ),
        ("symbol", "name", "seq", "status", "confidence", "effect"), "rk = 1", tables=DOCS,
    ),
    "q_v09_keyword_risks": Query(POSTS, (stage(**{k: f"has(content, k_{k})" for k in ("dilution", "dispute", "delisting", "pledge", "leak", "licence")}),), ("seq", "dilution", "dispute", "delisting", "pledge", "leak", "licence"), "dilution OR dispute OR delisting OR pledge OR leak OR licence", tables=DOCS),
    "q_v10_entry_constraint": stocks(RISK, "constraint_code"),
    "q_v11_constrained_label": stocks(RISK, "ev_label", "final_label"),
    "q_v12_decision": stocks(RISK, *r6("total_score", "ev", "risk_score"), "risk_band", "constraint_code", "final_label"),
    "q_v13_ps_ratio": quotes((stage(annual="CASE WHEN code % 2 = 0 AND revenue < 30 THEN revenue * 4 ELSE revenue END"), stage(ps="mcap / nullif(annual, 0)")), *r6("ps")),
    "q_v14_turnover_days": quotes((stage(_tr="n / 10.0", _days="CASE WHEN code % 4 = 0 THEN 45.0 END"), stage(turnover_days="CAST(coalesce(_days, CASE code % 3 WHEN 0 THEN 360 / nullif(_tr, 0) WHEN 1 THEN 360 / nullif(2 * _tr, 0) ELSE 360 / nullif(4 * _tr, 0) END) AS DOUBLE)")), *r6("turnover_days")),
    "q_v15_competitor_metrics": quotes((*VALUED, stage(rate="CASE WHEN industry % 5 = 0 THEN 7.8 WHEN industry % 5 = 1 THEN 7.2 ELSE 1.0 END"), stage(mcap_local="CAST(mcap * rate AS DOUBLE)")), *r6("fwd_pe", "growth", "peg", "ps", "mcap_local")),
    "q_v16_industry_pe": Query(QUOTES, VALUED, final="SELECT industry, count(fwd_pe) AS peers, round(avg(fwd_pe), 6) AS industry_fwd_pe FROM t GROUP BY industry", tables=LI),
    "q_v17_valuation_table": quotes((*VALUED, stage(cagr="CASE WHEN eps_this > 0 AND eps_next > 0 THEN power(eps_next / eps_this, 0.5) - 1 END")), *r6("fwd_pe", "cagr", "peg")),
    "q_v18_social_score": Query(
        POSTS, SENTIMENT,
        final="""SELECT symbol, CAST(least(90, greatest(10, 50 + 5 * (count(CASE WHEN sentiment = 'bull' THEN 1 END) - count(CASE WHEN sentiment = 'bear' THEN 1 END)))) AS BIGINT) AS social_score, max_by(seq, (likes + comments) * 1000000 - seq) AS top_post FROM t GROUP BY symbol""",
        tables=DOCS,
    ),
    "q_s13_quote_fields": Query("SELECT s_suppkey, concat_ws('~', CAST(s_suppkey AS VARCHAR(9)), s_name, CAST(s_acctbal AS VARCHAR(20)), '', 'x1') AS line FROM supplier", (stage(name=("split(line, '~')[1]", "string_split(line, '~')[2]"), price=("try_cast(split(line, '~')[2] AS DOUBLE)", "try_cast(string_split(line, '~')[3] AS DOUBLE)"), bad=("try_cast(split(line, '~')[4] AS DOUBLE)", "try_cast(string_split(line, '~')[5] AS DOUBLE)")),), ("s_suppkey", "name", "price", "bad"), tables=("supplier",)),
    "q_s14_market_cap": quotes((stage(flag="CASE WHEN float_mcap > 1.05 * mcap THEN 'market_cap_inconsistent' END", float_ok="CASE WHEN float_mcap <= 0 OR float_mcap > 1.05 * mcap THEN NULL ELSE float_mcap END"),), "flag", *r6("float_ok")),
    "q_s15_consensus": Query(
        "SELECT o_custkey % 50 AS code, o_orderpriority AS org, CASE WHEN o_orderkey % 9 = 0 THEN -1.0 ELSE o_totalprice / 100000 END AS eps_this, o_totalprice / 80000 AS eps_next FROM orders", (),
        final="SELECT code, round(avg(CASE WHEN eps_this > 0 THEN eps_this END), 6) AS eps_this, round(avg(CASE WHEN eps_next > 0 THEN eps_next END), 6) AS eps_next, count(DISTINCT CASE WHEN eps_this > 0 THEN org END) AS institutions FROM t GROUP BY code",
    ),
    "q_s18_manual_override": Query("SELECT c.c_custkey AS code, c.c_acctbal AS api_value, m.m_value FROM customer c LEFT JOIN (SELECT c_custkey AS k, 1000.5 + c_custkey AS m_value FROM customer WHERE c_custkey % 7 = 0) m ON c.c_custkey = m.k", (stage(value="CAST(coalesce(m_value, api_value) AS DOUBLE)", origin="CASE WHEN m_value IS NULL THEN 'api' ELSE 'manual' END"),), ("code", "value", "origin"), tables=("customer",)),
    "q_f01_flow_rows": Query(FLOW, (), ("symbol", "dt", *r6("main_in", "main_out", "main_net", "small", "change_pct")), tables=("events",)),
    "q_f02_flow_signal": Query(
        FLOW, FLOW_TOP,
        final="""SELECT symbol, count(*) AS days, round(sum(main_net), 6) AS main_net, round(sum(small), 6) AS small_net,
CASE WHEN sum(main_net) > 0 AND sum(change_pct) > 0 THEN 'inflow_up' WHEN sum(main_net) > 0 AND sum(change_pct) < 0 THEN 'inflow_down' WHEN sum(main_net) < 0 AND sum(change_pct) > 0 THEN 'outflow_up' WHEN sum(main_net) < 0 AND sum(change_pct) < 0 THEN 'outflow_down' ELSE 'flat' END AS signal
FROM t GROUP BY symbol""",
        tables=("events",),
    ),
    "q_f03_peer_rows": Query(
        PEER_ROWS,
        (stage(comparison="CASE WHEN abs(target_value - peer_value) < 0.01 THEN 'near' WHEN target_value > peer_value THEN 'above' ELSE 'below' END"),),
        ("code", "peer", "metric", *r6("target_value", "peer_value"), "comparison"),
        tables=LI,
    ),
    "q_f04_peer_confidence": quotes(PEER_CONFIDENCE, *r6("confidence"), "usage"),
    "q_f05_peer_filter": quotes((*PEER_CONFIDENCE, stage(where="usage <> 'drop'"), stage(shown="CASE WHEN usage = 'claim' THEN price END")), *r6("shown")),
    "q_f06_wording": quotes((*VALUED, stage(wording="CASE WHEN fwd_pe IS NULL OR industry_pe IS NULL THEN 'no comparison' WHEN abs(fwd_pe - industry_pe) < 0.01 THEN 'near the industry' WHEN fwd_pe > industry_pe THEN 'above the industry' ELSE 'below the industry' END")), "wording"),
}
