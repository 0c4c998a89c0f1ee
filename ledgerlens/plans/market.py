"""Queries over price bars: B, I, P, J and T operators with their SQL."""

from __future__ import annotations

from ..operators import indicators as ind
from ..operators import structure as st
from ..operators import trend as tr
from ..sources.tables import BARS, FRIDAY, INDEX_BARS, WEEKLY_BARS
from .folds import MACD
from .stages import Query, last, over, stage


def r6(*cols: str) -> tuple[str, ...]:
    return tuple(f"round({c}, 6) AS {c}" for c in cols)


def bars(stages, *select: str, source=BARS, where=None) -> Query:
    return Query(source, tuple(stages), ("symbol", "dt", *select), where)


_BEFORE = "p_n p_s4 p_s9 p_s19 p_above p_below p_crosses p_w5 p_w10 p_d5 p_d10 q_high q_low q_close q_n q_tr q_plus q_minus q_dx".split()
#: What the days of each week need of the weeks before it.
WEEKS = Query(WEEKLY_BARS, (*st.WEEKS_BEFORE, *st.WEEKLY_MOVES), ("symbol", "dt AS friday", *_BEFORE))
#: Daily bars with the weeks before them.
TREND_BARS = tuple(
    f"""SELECT d.*, {", ".join(f"w.{c}" for c in _BEFORE)} FROM (SELECT *, {end} AS week FROM ({BARS}) b) d
LEFT JOIN (SELECT symbol AS w_symbol, * FROM weeks) w ON d.symbol = w.w_symbol AND d.week = w.friday"""
    for end in FRIDAY
)
WITH_LINES = tuple(f"SELECT t.*, l.macd, l.macd_signal FROM ({t}) t LEFT JOIN (SELECT symbol AS l_symbol, dt AS l_dt, macd, macd_signal FROM lines) l ON t.symbol = l.l_symbol AND t.dt = l.l_dt" for t in TREND_BARS)


def judged(stages, *select: str, where=None, final=None) -> Query:
    """Over daily bars with their weekly trend to date."""
    return Query(TREND_BARS, (*st.WEEK_TO_DATE, *stages), ("symbol", "dt", *select), where, final, uses={"weeks": WEEKS})


def triggered(stages, *select: str, where=None, final=None) -> Query:
    """As `judged`, with the weekly directional index to date and the oscillator's lines."""
    return Query(WITH_LINES, (*st.WEEK_TO_DATE, *st.WEEKLY_ADX_TO_DATE, *stages), ("symbol", "dt", *select), where, final, uses={"weeks": WEEKS, "lines": MACD})


GAPS = (stage(prev_close=f"lag(close) {ind.PREV}"), stage(ratio="close / nullif(prev_close, 0)"), stage(is_gap="coalesce(abs(ratio - 1) > 0.25, false)"))

#: A corporate action on each symbol's first day of a year; some years have none.
ACTIONS = """a AS (SELECT symbol, ex_date, 0.05 * (year(ex_date) % 3) AS bonus
  FROM (SELECT o_orderpriority AS symbol, min(CAST(o_orderdate AS DATE)) AS ex_date FROM orders GROUP BY o_orderpriority, year(o_orderdate)) y)"""

QUERIES: dict[str, Query] = {
    "q_b00_bars": bars((), "open", "high", "low", "close", "volume", *r6("amount")),
    "q_b01_price_gaps": bars(GAPS, *r6("prev_close", "close", "ratio"), where="is_gap"),
    "q_b02_adjustment_check": Query(
        BARS,
        (*GAPS, stage(latest_gap=f"max(CASE WHEN is_gap THEN dt END) {over('UNBOUNDED PRECEDING AND CURRENT ROW')}", rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)"),
         stage(n_gaps=f"CAST(sum(CASE WHEN is_gap THEN 1 ELSE 0 END) {over('UNBOUNDED PRECEDING AND CURRENT ROW')} AS BIGINT)", max_gap=f"max(abs(ratio - 1)) {over('UNBOUNDED PRECEDING AND CURRENT ROW')}")),
        ("symbol", "n_gaps", "latest_gap", "round(max_gap, 6) AS max_gap", "n_gaps > 0 AS requires_adjustment", "CASE WHEN n_gaps > 0 THEN 'low' ELSE 'medium' END AS confidence_cap"),
        "rk = 1",
    ),
    # the actions after each bar: one running sum over bars and actions together; the SQL joins them by date
    "q_b03_exact_adjust": Query(
        (
            f"""WITH b AS ({BARS}), {ACTIONS},
u AS (SELECT symbol, dt, close, CAST(0 AS DOUBLE) AS lf, 0 AS is_action FROM b UNION ALL SELECT symbol, ex_date, NULL, ln(1 + bonus), 1 FROM a),
r AS (SELECT *, coalesce(sum(lf) OVER (PARTITION BY symbol ORDER BY dt DESC, is_action ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS factor FROM u)
SELECT symbol, dt, close, close / exp(factor) AS adjusted FROM r WHERE is_action = 0""",
            f"""WITH b AS ({BARS}), {ACTIONS},
f AS (SELECT b.symbol, b.dt, coalesce(sum(ln(1 + a.bonus)), 0) AS factor FROM b LEFT JOIN a ON a.symbol = b.symbol AND b.dt < a.ex_date GROUP BY b.symbol, b.dt)
SELECT b.symbol, b.dt, b.close, b.close / exp(f.factor) AS adjusted FROM b JOIN f ON b.symbol = f.symbol AND b.dt = f.dt""",
        ),
        (),
        ("symbol", "dt", "close", "round(adjusted, 4) AS adjusted"),
    ),
    "q_b04_gap_adjust": bars(
        (*GAPS, stage(_l="CASE WHEN is_gap THEN ln(ratio) ELSE 0 END"), stage(_f="coalesce(sum(_l) OVER (PARTITION BY symbol ORDER BY dt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"), stage(log_factor="round(_f, 6)")),
        "close",
        "log_factor + 0.0 AS log_factor",
    ),
    "q_b05_volume_reliable": Query(
        BARS,
        (*GAPS, stage(rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)", n=f"row_number() {over()}", latest_gap=f"max(CASE WHEN is_gap THEN dt END) {over('UNBOUNDED PRECEDING AND CURRENT ROW')}", first21=f"min(dt) {last(21)}")),
        ("symbol", "dt", "n >= 21 AND (latest_gap IS NULL OR latest_gap < first21) AS volume_reliable"),
        "rk = 1",
    ),
    "q_b06_weekly_bars": bars((), "open", "high", "low", "close", "volume", *r6("amount"), source=WEEKLY_BARS),
    "q_b08_base_measures": bars((stage(monthly_return=f"close / nullif(lag(close, 21) {ind.PREV}, 0) - 1", avg_amount=f"avg(amount) {last(20)} / 100000000"),), *r6("monthly_return", "avg_amount")),
    "q_i01_sma": bars((ind.sma(5), ind.sma(20), ind.sma(60)), *r6("sma5", "sma20", "sma60")),
    "q_i03_atr": bars(ind.atr(), *r6("tr", "atr14")),
    "q_i04_adx": bars(ind.adx(), *r6("plus_di", "minus_di", "adx")),
    "q_i05_cci": bars(ind.cci(), *r6("cci")),
    "q_i06_williams_r": bars(ind.williams_r(), *r6("williams_r")),
    "q_i07_stoch_rsi": bars(ind.stoch_rsi(), *r6("stoch_k", "stoch_d")),
    "q_i08_obv": bars(ind.OBV, "obv"),
    "q_i10_bollinger": bars(ind.bollinger(), *r6("boll_mid", "boll_upper", "boll_lower")),
    "q_i11_rsi": bars(ind.rsi(), *r6("rsi")),
    "q_i12_bias": bars((*ind.bias(5), *ind.bias(10)), *r6("bias5", "bias10", "bias5_rank", "bias10_rank"), "bias5_high", "bias5_low", "bias10_high", "bias10_low"),
    "q_i13_boll_state": bars(ind.BOLL_STATE, "boll_state", *r6("boll_width")),
    "q_i14_candle": bars(ind.CANDLE, *r6("body_pct", "body_atr"), "is_doji", "long_upper", "long_lower"),
    "q_i15_ma_direction": bars((ind.sma(20, name="ma20"), *ind.ma_direction("ma20")), "ma20_dir"),
    "q_i17_volume_context": bars(ind.VOLUME_CONTEXT, *r6("volume_ratio"), "volume_side"),
    "q_i18_slopes": bars(ind.SLOPES, *r6("obv_slope", "price_slope")),
    "q_i19_chart_sma": bars((stage(sma20=ind.strict("avg(close)", 20)),), *r6("sma20")),
    "q_p01_swings": bars((*st.swings("low", 3, 3),), "low", "swing_low", where="swing_low"),
    "q_p03_terminal_shock": bars(st.TERMINAL_SHOCK, "shock", where="shock <> 'none'"),
    "q_p04_sr_conversion": bars(st.SR_CONVERSION, "sr_conversion"),
    "q_p05_weekly_trend": bars(st.WEEKLY_TREND, "weekly_trend", "above6", "below6", "crosses", source=WEEKLY_BARS),
    "q_p06_support_resistance": Query(st.levels_source(BARS), (), ("symbol", "kind", "bucket", "touches", "first_touch", "zone_low", "zone_high", "strong", "usable")),
    "q_p02_structure_path": Query(
        BARS,
        (
            stage(back="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)"),
            stage(where="back <= 80"),
            *st.swings("low", 3, 3, "l"),
            *st.swings("high", 3, 3, "h"),
            stage(kind="CASE WHEN l_low AND NOT h_high THEN 'low' WHEN h_high AND NOT l_low THEN 'high' END", where="(l_low AND NOT h_high) OR (h_high AND NOT l_low)"),
            stage(_new=f"CASE WHEN kind = lag(kind) {ind.PREV} THEN 0 ELSE 1 END"),
            stage(run=f"CAST(sum(_new) {over('UNBOUNDED PRECEDING AND CURRENT ROW')} AS BIGINT)"),
            stage(rk="row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN kind = 'low' THEN low ELSE -high END, dt)", where="rk = 1"),
            stage(price="CASE WHEN kind = 'low' THEN low ELSE high END"),
            stage(_p2=f"lag(price, 2) {ind.PREV}", next_price=f"lead(price) {ind.PREV}"),
            stage(relation="CASE WHEN _p2 IS NULL THEN 'first' WHEN price > _p2 * 1.01 THEN 'higher' WHEN price < _p2 * 0.99 THEN 'lower' ELSE 'flat' END", segment="CASE WHEN next_price IS NULL THEN 'open' WHEN abs(next_price / price - 1) <= 0.01 THEN 'flat' WHEN next_price > price THEN 'up' ELSE 'down' END"),
        ),
        ("symbol", "dt", "kind", "price", "relation", "segment"),
    ),
    "q_p07_low_structure": Query(
        BARS,
        (
            stage(back="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)", n=f"row_number() {over()}", _rng=f"avg(high - low) {last(14)}"),
            stage(where="back <= 60"),
            *st.swings("low", 2, 2),
            stage(_tol="greatest(0.01, 0.5 * first_value(_rng) OVER (PARTITION BY symbol ORDER BY dt DESC) / first_value(close) OVER (PARTITION BY symbol ORDER BY dt DESC))"),
            stage(where="swing_low"),
            stage(prev_low=f"lag(low) {ind.PREV}", gap=f"n - lag(n) {ind.PREV}", rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)"),
        ),
        ("symbol", "dt", "low", "prev_low", "CAST(gap AS BIGINT) AS gap", "CASE WHEN prev_low IS NULL THEN 'unknown' WHEN low > prev_low * (1 + _tol) THEN 'rising' WHEN low < prev_low * (1 - _tol) THEN 'falling' ELSE 'flat' END AS lows"),
        "rk = 1",
    ),
    "q_p08_channel": Query(
        BARS,
        (
            stage(back="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)", n_bars="count(*) OVER (PARTITION BY symbol)"),
            stage(bar="CAST(least(n_bars, 40) - back AS DOUBLE)", where="back <= 40"),
        ),
        final=tuple(
            f"""SELECT symbol, state, CASE WHEN state = 'box' THEN CASE WHEN by_share THEN 'medium' ELSE 'high' END WHEN state = 'none' THEN 'low' WHEN abs(su - sl) <= 0.005 THEN 'high' ELSE 'low' END AS confidence, round(upper_rail, 4) AS upper_rail, round(lower_rail, 4) AS lower_rail,
CASE WHEN state = 'none' OR upper_rail <= lower_rail THEN 'unknown' WHEN last_close > upper_rail THEN 'above' WHEN last_close < lower_rail THEN 'below' WHEN (upper_rail - last_close) / (upper_rail - lower_rail) < 0.15 THEN 'near_upper' WHEN (last_close - lower_rail) / (upper_rail - lower_rail) < 0.15 THEN 'near_lower' ELSE 'middle' END AS position,
CASE WHEN state = 'none' THEN 'none' WHEN low2 > upper_rail THEN 'up_confirmed' WHEN high2 < lower_rail THEN 'down_confirmed' ELSE 'none' END AS breakout
FROM (SELECT *, CASE WHEN by_share OR (abs(su) < 0.005 AND abs(sl) < 0.005) THEN 'box' WHEN su > 0 AND sl > 0 THEN 'up_channel' WHEN su < 0 AND sl < 0 THEN 'down_channel' ELSE 'none' END AS state,
  CASE WHEN by_share THEN share_high ELSE fit_high END AS upper_rail, CASE WHEN by_share THEN share_low ELSE fit_low END AS lower_rail
FROM (SELECT symbol, regr_slope(high, bar) / avg(close) AS su, regr_slope(low, bar) / avg(close) AS sl, abs(regr_slope(high, bar)) / avg(close) > 0.01 OR abs(regr_slope(low, bar)) / avg(close) > 0.01 AS by_share,
  regr_intercept(high, bar) + regr_slope(high, bar) * max(bar) AS fit_high, regr_intercept(low, bar) + regr_slope(low, bar) * max(bar) AS fit_low, {p[0]} AS share_high, {p[1]} AS share_low,
  max_by(close, bar) AS last_close, min(CASE WHEN back <= 2 THEN close END) AS low2, max(CASE WHEN back <= 2 THEN close END) AS high2 FROM t GROUP BY symbol) x) y"""
            for p in (("percentile(high, 0.95)", "percentile(low, 0.05)"), ("quantile_cont(high, 0.95)", "quantile_cont(low, 0.05)"))
        ),
    ),
    "q_p09_bottoming": judged(tr.STRATEGY, "bottom_score", "bottoming"),
    "q_p10_candle_at_level": bars(
        (*ind.CANDLE, *ind.bollinger(), stage(_s=f"min(low) {over('60 PRECEDING AND 1 PRECEDING')}", _r=f"max(high) {over('60 PRECEDING AND 1 PRECEDING')}"),
         stage(near="CASE WHEN abs(close / nullif(_s, 0) - 1) <= 0.03 THEN 'support' WHEN abs(close / nullif(_r, 0) - 1) <= 0.03 THEN 'resistance' WHEN abs(close / nullif(boll_lower, 0) - 1) <= 0.02 THEN 'boll_lower' WHEN abs(close / nullif(boll_upper, 0) - 1) <= 0.02 THEN 'boll_upper' ELSE 'none' END"),
         stage(candle_signal="CASE WHEN near = 'none' THEN 'none' WHEN is_doji THEN concat('doji_', near) WHEN long_lower AND near IN ('support', 'boll_lower') THEN 'rejection_up' WHEN long_upper AND near IN ('resistance', 'boll_upper') THEN 'rejection_down' ELSE 'none' END")),
        "near",
        "candle_signal",
    ),
    "q_p11_double_top": Query(
        BARS,
        (
            stage(back="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)"),
            stage(where="back <= 30"),
            stage(_b=f"lag(close) {ind.PREV}", _a=f"lead(close) {ind.PREV}"),
            stage(peak="coalesce(close > _b AND close > _a, false)", dip="coalesce(close < _b AND close < _a, false)"),
            stage(prk="CASE WHEN peak THEN row_number() OVER (PARTITION BY symbol, peak ORDER BY close DESC, dt) END", drk="CASE WHEN dip THEN row_number() OVER (PARTITION BY symbol, dip ORDER BY close, dt) END"),
            stage(p1="max(CASE WHEN prk = 1 THEN dt END) OVER (PARTITION BY symbol)", p2="max(CASE WHEN prk = 2 THEN dt END) OVER (PARTITION BY symbol)", v1="max(CASE WHEN prk = 1 THEN close END) OVER (PARTITION BY symbol)", v2="max(CASE WHEN prk = 2 THEN close END) OVER (PARTITION BY symbol)",
                  d1="max(CASE WHEN drk = 1 THEN dt END) OVER (PARTITION BY symbol)", d2="max(CASE WHEN drk = 2 THEN dt END) OVER (PARTITION BY symbol)", w1="max(CASE WHEN drk = 1 THEN close END) OVER (PARTITION BY symbol)", w2="max(CASE WHEN drk = 2 THEN close END) OVER (PARTITION BY symbol)"),
        ),
        final="""SELECT symbol, max(v1) AS top1, max(v2) AS top2, min(CASE WHEN dt BETWEEN p1 AND p2 THEN close END) AS valley,
coalesce(max(p1) < max(p2) AND max(v2) >= max(v1) * 0.97 AND min(CASE WHEN dt BETWEEN p1 AND p2 THEN close END) <= 0.97 * max(v2), false) AS double_top,
coalesce(max(d1) < max(d2) AND max(w2) <= max(w1) * 1.03 AND max(CASE WHEN dt BETWEEN d1 AND d2 THEN close END) >= 1.03 * max(w2), false) AS double_bottom
FROM t GROUP BY symbol""",
    ),
    "q_p13_momentum_extreme": bars(st.MOMENTUM_EXTREME, "momentum_extreme"),
    "q_p14_divergence": Query(
        BARS,
        (
            *ind.rsi(),
            stage(back="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)"),
            stage(where="back <= 80"),
            *st.swings("low", 3, 3, "l"),
            *st.swings("high", 3, 3, "h"),
            stage(kind="CASE WHEN l_low THEN 'bullish' ELSE 'bearish' END", price="CASE WHEN l_low THEN low ELSE high END", where="l_low OR h_high"),
            stage(_pp="lag(price) OVER (PARTITION BY symbol, kind ORDER BY dt)", _pr="lag(rsi) OVER (PARTITION BY symbol, kind ORDER BY dt)"),
            stage(divergence="coalesce(CASE WHEN kind = 'bullish' THEN price < _pp * 0.99 AND rsi > _pr ELSE price > _pp * 1.01 AND rsi < _pr END, false)"),
        ),
        ("symbol", "dt", "kind", "price", "divergence", "back <= 10 AS fresh"),
    ),
    "q_p16_fibonacci": bars((stage(_lo=f"min(low) {last(60)}", _hi=f"max(high) {last(60)}"), stage(fib_1272="_hi + (_hi - _lo) * 0.272", fib_1618="_hi + (_hi - _lo) * 0.618")), *r6("fib_1272", "fib_1618")),
    "q_p17_fib_convergence": judged(tr.TARGET, *r6("fib_1272", "measured"), "converged"),
    "q_p18_measured_move": judged(tr.TARGET, "bull", *r6("measured")),
    "q_p19_false_rebound": bars(st.FALSE_REBOUND, "false_rebound", "false_breakout"),
    "q_j01_trend_stage": judged(tr.TREND_STAGE, "trend_stage"),
    "q_j02_stage_change": judged(tr.STAGE_CHANGE, "trend_stage", "stage_change"),
    "q_j03_trend_health": judged(tr.HEALTH, "health", "health_grade"),
    "q_j04_volume_score": bars((*ind.VOLUME_CONTEXT, tr.VOLUME_SCORE), "volume_score"),
    "q_j05_bias_extreme": bars((*ind.bias(5), *ind.bias(10), stage(bias_alert="CASE WHEN bias5_high OR bias10_high THEN 'new_high' WHEN bias5_low OR bias10_low THEN 'new_low' ELSE 'none' END")), "bias_alert"),
    "q_j06_sell_factors": judged(tr.SELL_FACTORS, "sell_factors", "sell_action"),
    "q_j07_invalidation": judged(tr.INVALIDATION, "level_kind", "invalidation", *r6("level", "distance_pct")),
    "q_j08_judgment": judged(tr.JUDGMENT, "judgment"),
    "q_j09_quality_cap": judged((*tr.JUDGMENT, *GAPS, stage(_g=f"max(CASE WHEN is_gap THEN 1 ELSE 0 END) {over('UNBOUNDED PRECEDING AND CURRENT ROW')}"), stage(cap="CASE WHEN _g = 1 THEN 0 ELSE sample_rank END")), "sample_rank", "cap"),
    "q_j10_trigger_checks": triggered(tr.TRIGGERS, "price_check", "trend_check", "volume_check", "momentum_check"),
    "q_j11_execution": triggered(tr.TRIGGERS, "execution", "action"),
    "q_j12_display_mode": triggered(tr.TRIGGERS, "display_mode"),
    "q_j13_alignment": judged(tr.ALIGNMENT, "posture", "alignment"),
    "q_j14_scenario_ladder": judged(
        (*tr.TREND_INPUTS, *ind.bollinger(), stage(rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)", hi60=f"max(high) {last(60)}", lo60=f"min(low) {last(60)}"), stage(where="rk = 1")),
        final="""SELECT symbol, side, round(level, 4) AS level, source, CAST(step AS BIGINT) AS step FROM (
SELECT symbol, side, level, source, row_number() OVER (PARTITION BY symbol, side ORDER BY abs(level - close), source) AS step FROM (
SELECT symbol, close, level, source, CASE WHEN level > close THEN 'up' ELSE 'down' END AS side FROM (
SELECT symbol, close, ma20 AS level, 'ma20' AS source FROM t UNION ALL SELECT symbol, close, ma60, 'ma60' FROM t UNION ALL SELECT symbol, close, boll_upper, 'boll_upper' FROM t
UNION ALL SELECT symbol, close, boll_lower, 'boll_lower' FROM t UNION ALL SELECT symbol, close, hi60, 'high60' FROM t UNION ALL SELECT symbol, close, lo60, 'low60' FROM t) a
WHERE abs(level / close - 1) >= 0.005) b) c WHERE step <= 3""",
    ),
    "q_j16_judgment_table": triggered(
        (*tr.TRIGGERS, stage(rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)")),
        "'technical_judgment.v1' AS schema_version", "judgment", "health", "confidence", "execution", "display_mode", "action",
        where="rk = 1",
    ),
    "q_j17_advice": judged(tr.ADVICE, "bias_text", "boll_text", "rsi_text"),
    "q_j18_staged_entry": judged(tr.STRATEGY, "staged_entry"),
    "q_j19_index_stage": bars(tr.INDEX_STAGE, "index_stage", source=INDEX_BARS),
    "q_j20_resonance": Query(
        f"""WITH s AS ({BARS}), m AS ({INDEX_BARS}),
sm AS (SELECT symbol, dt, close, avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a, avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS b FROM s),
mm AS (SELECT dt, close, avg(close) OVER (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a, avg(close) OVER (ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS b FROM m)
SELECT sm.symbol, sm.dt,
  CASE WHEN sm.close > sm.a AND sm.a > sm.b THEN 2 WHEN sm.close > sm.a THEN 1 WHEN sm.close < sm.a AND sm.a < sm.b THEN -2 WHEN sm.close < sm.a THEN -1 ELSE 0 END AS stock_strength,
  CASE WHEN mm.close > mm.a AND mm.a > mm.b THEN 2 WHEN mm.close > mm.a THEN 1 WHEN mm.close < mm.a AND mm.a < mm.b THEN -2 WHEN mm.close < mm.a THEN -1 ELSE 0 END AS market_strength
FROM sm JOIN mm ON sm.dt = mm.dt""",
        (stage(resonance="CASE WHEN stock_strength > 0 AND market_strength > 0 THEN 'together_up' WHEN stock_strength < 0 AND market_strength < 0 THEN 'together_down' WHEN stock_strength > 0 THEN 'stock_leads' WHEN market_strength > 0 THEN 'stock_lags' ELSE 'mixed' END", relative="stock_strength - market_strength"),),
        ("symbol", "dt", "stock_strength", "market_strength", "resonance", "relative"),
    ),
    "q_j21_index_mapping": Query(
        "SELECT s_suppkey, lpad(CAST(s_suppkey * 7919 % 700000 AS VARCHAR(9)), 6, '0') AS code FROM supplier",
        (stage(index_code="CASE WHEN substr(code, 1, 3) IN ('600', '601', '603', '605') THEN 'main_a' WHEN substr(code, 1, 3) IN ('000', '001', '002', '003') THEN 'main_b' WHEN substr(code, 1, 3) = '300' THEN 'growth' WHEN substr(code, 1, 3) = '688' THEN 'star' ELSE 'broad' END"),),
        ("s_suppkey", "code", "index_code"),
        tables=("supplier",),
    ),
    "q_j22_confidence": judged(tr.JUDGMENT, "confidence"),
    "q_t01_weekly_adx": bars((*ind.adx(), *ind.bollinger(), stage(_mx=f"max(adx) {last(4)}", _mw=f"max((boll_upper - boll_lower) / nullif(boll_mid, 0)) {last(4)}"), stage(weekly_points="CASE WHEN adx > 30 THEN 10 WHEN adx > 25 THEN 7 WHEN adx > 20 THEN 4 ELSE 0 END", weekly_side="CASE WHEN _mx < 20 AND _mw < 0.08 THEN 'ranging' WHEN plus_di > minus_di THEN 'up' WHEN plus_di < minus_di THEN 'down' ELSE 'none' END")), "weekly_points", "weekly_side", source=WEEKLY_BARS),
    "q_t02_daily_trend": judged(tr.TARGET, "daily_trend"),
    "q_t04_targets": judged(tr.TARGET, *r6("conservative", "base_target", "aggressive"), "is_far"),
    "q_t05_profit_risk": judged(tr.TARGET, *r6("trigger", "stop", "profit_risk"), "passes_filter"),
    "q_t06_target_confidence": judged(tr.TARGET, *r6("score"), "target_confidence"),
    "q_t07_eta": judged(tr.TARGET, *r6("eta_low", "eta_high")),
    "q_t09_target_status": judged(tr.TARGET, "target_status"),
}

FLAGSHIP = judged(
    (*tr.HEALTH, stage(rk="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)")),
    "close", *r6("ma20", "boll_upper", "boll_lower", "rsi", "adx"), "trend_stage", "health", "health_grade",
    where="rk = 1",
)
QUERIES["q_flagship"] = FLAGSHIP
