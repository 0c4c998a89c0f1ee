"""Swing structure, patterns and levels."""

from __future__ import annotations

from ..plans.stages import Stage, last, over, stage
from .indicators import BOLL_STATE, PREV, adx, atr, ma_direction, rsi


def swings(column: str, left: int, right: int, name: str = "swing") -> tuple[Stage, ...]:
    """Confirmed swings: strictly beyond all `left` values before and `right` after; none near a missing value."""
    before, after = over(f"{left} PRECEDING AND 1 PRECEDING"), over(f"1 FOLLOWING AND {right} FOLLOWING")
    full = f"count({column}) {before} = {left} AND count({column}) {after} = {right}"
    return (
        stage(
            **{
                f"{name}_low": f"coalesce({full} AND {column} < min({column}) {before} AND {column} < min({column}) {after}, false)",
                f"{name}_high": f"coalesce({full} AND {column} > max({column}) {before} AND {column} > max({column}) {after}, false)",
            }
        ),
    )


RANK = stage(bar=f"row_number() {over()}", back="row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)")

TERMINAL_SHOCK = (
    *atr(14),
    stage(_pa=f"lag(atr14) {PREV}", _range="high - low"),
    stage(_tr="tr / nullif(_pa, 0)", _body="abs(close - open) / nullif(_range, 0)", _pos="(close - low) / nullif(_range, 0)"),
    stage(shock="CASE WHEN _tr >= 1.5 AND _body >= 0.65 AND _pos >= 0.8 AND close > open THEN 'up' WHEN _tr >= 1.5 AND _body >= 0.65 AND _pos <= 0.2 AND close < open THEN 'down' ELSE 'none' END"),
)

WEEKLY_TREND = (
    stage(w5=f"avg(close) {last(5)}", w10=f"avg(close) {last(10)}", w20=f"avg(close) {last(20)}", n_weeks=f"row_number() {over()}"),
    stage(
        w_above="CASE WHEN close > w5 AND close > w10 THEN 1 ELSE 0 END",
        w_below="CASE WHEN close < w5 AND close < w10 THEN 1 ELSE 0 END",
        w_s5=f"w5 / nullif(lag(w5, 3) {PREV}, 0) - 1",
        w_s10=f"w10 / nullif(lag(w10, 3) {PREV}, 0) - 1",
        w_c5=f"(close - w5) * lag(close - w5) {PREV}",
        w_c10=f"(close - w10) * lag(close - w10) {PREV}",
    ),
    stage(
        above6=f"CAST(sum(w_above) {last(6)} AS BIGINT)",
        below6=f"CAST(sum(w_below) {last(6)} AS BIGINT)",
        crosses=f"CAST(sum(CASE WHEN w_c5 < 0 OR w_c10 < 0 THEN 1 ELSE 0 END) {last(10)} AS BIGINT)",
        w_gap="coalesce(abs(w5 - w10) / nullif(w10, 0), 0)",
    ),
    stage(weekly_trend="CASE WHEN n_weeks < 20 THEN 'unknown' WHEN above6 >= 5 AND w5 > w10 AND w10 > w20 AND w_s5 > 0 AND w_s10 > 0 THEN 'up' WHEN below6 >= 5 AND w5 < w10 AND w10 < w20 AND w_s5 < 0 AND w_s10 < 0 THEN 'down' WHEN crosses >= 3 OR w_gap < 0.02 THEN 'ranging' ELSE 'repairing' END"),
)

_BEFORE = {n: over(f"{n} PRECEDING AND 1 PRECEDING") for n in (4, 5, 9, 13, 19)}

#: What a week's days need of the weeks before it: sums and counts of closes, flags, lagged averages, and movements.
WEEKS_BEFORE = (
    *WEEKLY_TREND,
    stage(
        p_n="n_weeks - 1",
        p_s4=f"sum(close) {_BEFORE[4]}",
        p_s9=f"sum(close) {_BEFORE[9]}",
        p_s19=f"sum(close) {_BEFORE[19]}",
        p_above=f"sum(w_above) {_BEFORE[5]}",
        p_below=f"sum(w_below) {_BEFORE[5]}",
        p_crosses=f"sum(CASE WHEN w_c5 < 0 OR w_c10 < 0 THEN 1 ELSE 0 END) {_BEFORE[9]}",
        p_w5=f"lag(w5, 3) {PREV}",
        p_w10=f"lag(w10, 3) {PREV}",
        p_d5=f"lag(close - w5) {PREV}",
        p_d10=f"lag(close - w10) {PREV}",
    ),
)

#: The weekly trend as of each day: the weeks before it and the week up to that day. A day sees no later one.
WEEK_TO_DATE = (
    stage(
        w5="(coalesce(p_s4, 0) + close) / (least(p_n, 4) + 1)",
        w10="(coalesce(p_s9, 0) + close) / (least(p_n, 9) + 1)",
        w20="(coalesce(p_s19, 0) + close) / (least(p_n, 19) + 1)",
    ),
    stage(
        above6="CAST(coalesce(p_above, 0) + CASE WHEN close > w5 AND close > w10 THEN 1 ELSE 0 END AS BIGINT)",
        below6="CAST(coalesce(p_below, 0) + CASE WHEN close < w5 AND close < w10 THEN 1 ELSE 0 END AS BIGINT)",
        crosses="CAST(coalesce(p_crosses, 0) + CASE WHEN (close - w5) * p_d5 < 0 OR (close - w10) * p_d10 < 0 THEN 1 ELSE 0 END AS BIGINT)",
        w_s5="w5 / nullif(p_w5, 0) - 1",
        w_s10="w10 / nullif(p_w10, 0) - 1",
        w_gap="coalesce(abs(w5 - w10) / nullif(w10, 0), 0)",
    ),
    stage(
        weekly_trend="""CASE WHEN p_n < 19 THEN 'unknown'
 WHEN above6 >= 5 AND w5 > w10 AND w10 > w20 AND w_s5 > 0 AND w_s10 > 0 THEN 'up'
 WHEN below6 >= 5 AND w5 < w10 AND w10 < w20 AND w_s5 < 0 AND w_s10 < 0 THEN 'down'
 WHEN crosses >= 3 OR w_gap < 0.02 THEN 'ranging' ELSE 'repairing' END"""
    ),
)

#: Weekly movements, and their sums over the weeks before, for the directional index as of each day.
WEEKLY_MOVES = (
    *adx(),
    stage(
        q_high=f"lag(high) {PREV}",
        q_low=f"lag(low) {PREV}",
        q_close=f"lag(close) {PREV}",
        q_n=f"count(*) {_BEFORE[13]}",
        q_tr=f"sum(tr) {_BEFORE[13]}",
        q_plus=f"sum(plus_dm) {_BEFORE[13]}",
        q_minus=f"sum(minus_dm) {_BEFORE[13]}",
        q_dx=f"sum(dx) {_BEFORE[13]}",
    ),
)
_DAYS = "OVER (PARTITION BY symbol, week ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WEEKLY_ADX_TO_DATE = (
    stage(w_high=f"max(high) {_DAYS}", w_low=f"min(low) {_DAYS}"),
    stage(
        w_tr="greatest(w_high - w_low, abs(w_high - q_close), abs(w_low - q_close))",
        w_up="greatest(coalesce(w_high - q_high, 0), 0)",
        w_down="greatest(coalesce(q_low - w_low, 0), 0)",
    ),
    stage(w_plus="CASE WHEN w_up > w_down THEN w_up ELSE 0 END"),
    stage(w_minus="CASE WHEN w_down > w_plus THEN w_down ELSE 0 END"),
    stage(
        weekly_plus_di="100 * (coalesce(q_plus, 0) + w_plus) / nullif(coalesce(q_tr, 0) + w_tr, 0)",
        weekly_minus_di="100 * (coalesce(q_minus, 0) + w_minus) / nullif(coalesce(q_tr, 0) + w_tr, 0)",
    ),
    stage(w_dx="coalesce(100 * abs(weekly_plus_di - weekly_minus_di) / nullif(weekly_plus_di + weekly_minus_di, 0), 0)"),
    stage(weekly_adx="(coalesce(q_dx, 0) + w_dx) / (coalesce(q_n, 0) + 1)"),
)

#: Rising, falling or flat rails of the last 40 bars, as of each bar.
_RAIL = over("39 PRECEDING AND CURRENT ROW")
CHANNEL = (
    stage(_bar=f"CAST(row_number() {over()} AS DOUBLE)"),
    stage(_rails=f"count(*) {_RAIL}", _level=f"avg(close) {_RAIL}", _sh=f"regr_slope(high, _bar) {_RAIL}", _sl=f"regr_slope(low, _bar) {_RAIL}"),
    stage(_uh="_sh / nullif(_level, 0)", _ul="_sl / nullif(_level, 0)"),
    stage(
        channel="""CASE WHEN _rails < 40 OR _uh IS NULL OR _ul IS NULL THEN 'none'
 WHEN abs(_uh) > 0.01 OR abs(_ul) > 0.01 OR (abs(_uh) < 0.005 AND abs(_ul) < 0.005) THEN 'box'
 WHEN _uh > 0 AND _ul > 0 THEN 'up_channel' WHEN _uh < 0 AND _ul < 0 THEN 'down_channel' ELSE 'none' END"""
    ),
)


def levels_source(bars: str, lookback: int = 250) -> tuple[str, str]:
    """Touches of support and resistance of the last `lookback` bars, in buckets."""
    out = []
    for spark in (True, False):
        bround = "CAST(bround(px / unit, 0) AS BIGINT)" if spark else "CAST(round_even(px / unit, 0) AS BIGINT)"
        out.append(f"""
WITH b AS ({bars}),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS back, lag(close) OVER (PARTITION BY symbol ORDER BY dt) AS pc FROM b),
l AS (SELECT *, avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM r WHERE back <= {lookback}),
x AS (SELECT *, first_value(atr) OVER (PARTITION BY symbol ORDER BY dt DESC) AS atr_last, first_value(close) OVER (PARTITION BY symbol ORDER BY dt DESC) AS price,
    min(low) OVER c AS cmin, max(high) OVER c AS cmax, count(*) OVER c AS cn,
    max(close) OVER f AS fmax, min(close) OVER f AS fmin
  FROM l WINDOW c AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
y AS (SELECT *, greatest(0.005 * price, 0.5 * atr_last) AS unit, greatest(0.02 * price, atr_last) AS needed FROM x),
z AS (
  SELECT symbol, dt, price, unit, 'support' AS kind, low AS px FROM y WHERE cn = 5 AND low = cmin AND fmax - low >= needed
  UNION ALL SELECT symbol, dt, price, unit, 'resistance' AS kind, high AS px FROM y WHERE cn = 5 AND high = cmax AND high - fmin >= needed),
k AS (SELECT symbol, kind, {bround} AS bucket, count(*) AS touches, min(dt) AS first_touch, min(px) AS zone_low, max(px) AS zone_high, max(price) AS price FROM z GROUP BY symbol, kind, {bround}),
m AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY touches DESC, first_touch, bucket) AS rk FROM k)
SELECT symbol, kind, bucket, touches, first_touch, zone_low, zone_high, price, touches >= 5 AS strong,
  CASE WHEN kind = 'support' THEN zone_low < price ELSE zone_high > price END AS usable
FROM m WHERE rk = 1 AND touches >= 3""")
    return out[0], out[1]


FALSE_REBOUND = (
    *BOLL_STATE,
    stage(ma5=f"avg(close) {last(5)}", _vm=f"avg(volume) {last(20)}", _pc=f"lag(close) {PREV}", _p2=f"lag(close, 2) {PREV}"),
    stage(_pm5=f"lag(ma5) {PREV}"),
    stage(
        false_rebound="coalesce(close > _pc AND _pc <= _p2 AND boll_state <> 'opening' AND volume < 1.2 * _vm, false)",
        false_breakout="coalesce(_pc > _pm5 AND close < ma5, false)",
    ),
)

SR_CONVERSION = (
    stage(_zh=f"max(high) {over('60 PRECEDING AND 5 PRECEDING')}", _zl=f"min(low) {over('60 PRECEDING AND 5 PRECEDING')}", _n=f"count(*) {last(3)}", _min3=f"min(close) {last(3)}", _max3=f"max(close) {last(3)}"),
    stage(sr_conversion="CASE WHEN _n < 3 OR _zh IS NULL THEN 'none' WHEN _min3 > _zh AND close > 1.01 * _zh THEN 'resistance_broken' WHEN _max3 < _zl THEN 'support_broken' ELSE 'none' END"),
)

MOMENTUM_EXTREME = (
    *BOLL_STATE,
    *rsi(),
    stage(
        hot="CASE WHEN close > boll_upper * 1.01 THEN 1 ELSE 0 END + CASE WHEN rsi > 75 THEN 1 ELSE 0 END",
        cold="CASE WHEN close < boll_lower * 0.99 THEN 1 ELSE 0 END + CASE WHEN rsi < 25 THEN 1 ELSE 0 END",
    ),
    stage(momentum_extreme="CASE WHEN greatest(hot, cold) = 0 THEN 'none' WHEN hot >= cold THEN concat('hot_', CAST(hot AS VARCHAR(9))) ELSE concat('cold_', CAST(cold AS VARCHAR(9))) END"),
)

#: Over bars with the trend of their week.
TREND_INPUTS = (
    stage(ma5=f"avg(close) {last(5)}", ma10=f"avg(close) {last(10)}", ma20=f"avg(close) {last(20)}", ma60=f"avg(close) {last(60)}", n_bars=f"row_number() {over()}"),
    *ma_direction("ma20"),
    *ma_direction("ma60"),
    *rsi(),
    *adx(),
    *atr(14),
)
