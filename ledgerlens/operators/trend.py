"""Trend stages, health and judgment as decision expressions over indicators.

Labels are ASCII codes. Order of the branches is the priority.
"""

from __future__ import annotations

from ..plans.stages import Stage, last, over, stage
from .indicators import BOLL_STATE, PREV, VOLUME_CONTEXT, bias
from .structure import CHANNEL, TREND_INPUTS

STAGE = stage(
    trend_stage="""CASE
 WHEN close <= ma60 OR weekly_trend = 'down' THEN 'broken'
 WHEN close <= ma20 AND ma20_dir IN ('flat', 'down') THEN CASE WHEN weekly_trend = 'ranging' AND ma60_dir = 'up' THEN 'near_break' ELSE 'weakening' END
 WHEN close > ma20 * 1.05 AND rsi > 70 AND boll_state = 'opening' THEN 'high_dull'
 WHEN close > ma20 * 1.03 AND boll_state = 'opening' THEN 'accelerating'
 WHEN close > ma20 AND ma20_dir = 'up' AND ma60_dir IN ('up', 'flat') THEN 'advancing'
 WHEN close > ma20 AND weekly_trend IN ('repairing', 'ranging') THEN 'starting'
 WHEN close <= ma20 AND ma20_dir = 'up' AND ma60_dir = 'up' THEN 'pullback'
 ELSE 'ranging' END"""
)
TREND_STAGE = (*BOLL_STATE, *TREND_INPUTS, STAGE)
STAGE_CHANGE = (*TREND_STAGE, stage(previous_stage=f"lag(trend_stage) {PREV}"), stage(stage_change="CASE WHEN previous_stage IS NULL THEN 'first' WHEN previous_stage = trend_stage THEN 'same' ELSE concat(previous_stage, '>', trend_stage) END"))

VOLUME_SCORE = stage(
    volume_score="""CASE WHEN volume_ratio IS NULL OR volume_side IN ('mixed', 'unknown') THEN 5
 WHEN volume_side = 'bullish' THEN CASE WHEN volume_ratio >= 1.5 THEN 9 WHEN volume_ratio >= 1.2 THEN 7 WHEN volume_ratio >= 0.8 THEN 6 ELSE 4 END
 ELSE CASE WHEN volume_ratio >= 1.5 THEN 1 WHEN volume_ratio >= 1.2 THEN 3 WHEN volume_ratio >= 0.8 THEN 4 ELSE 5 END END"""
)

#: Points: the week 25/10/5, the 20-bar average 20/12/12/8/5, structure 12/5, volume 1-9, bands 7/5, less heat 5 and 3.
HEALTH = (
    *TREND_STAGE,
    *CHANNEL,
    *VOLUME_CONTEXT,
    VOLUME_SCORE,
    *bias(5),
    stage(
        _pts="""CASE weekly_trend WHEN 'up' THEN 25 WHEN 'ranging' THEN 10 ELSE 5 END
 + CASE WHEN ma20_dir = 'up' AND close > ma20 THEN 20 WHEN ma20_dir = 'up' THEN 12 WHEN ma20_dir = 'flat' AND close > ma20 THEN 12 WHEN ma20_dir = 'flat' THEN 8 ELSE 5 END
 + CASE WHEN channel = 'up_channel' THEN 12 ELSE 5 END + volume_score + CASE WHEN boll_state = 'opening' THEN 7 ELSE 5 END
 - CASE WHEN rsi > 75 THEN 5 ELSE 0 END - CASE WHEN bias5 > 5 THEN 3 ELSE 0 END"""
    ),
    stage(_clamped="least(greatest(_pts, 0), 100)", _held="ma60_dir = 'up' AND close > ma60"),
    stage(health="CAST(CASE WHEN _held AND _clamped < 50 THEN least(50, _clamped + 15) ELSE _clamped END AS INTEGER)"),
    stage(health_grade="CASE WHEN health >= 80 THEN 'A' WHEN health >= 65 THEN 'B' WHEN health >= 50 THEN 'C' WHEN health >= 30 THEN CASE WHEN _held THEN 'C' ELSE 'D' END ELSE 'E' END"),
)

SELL_FACTORS = (
    *HEALTH,
    stage(_over="CASE WHEN close > 1.3 * ma60 THEN 1 ELSE 0 END", _break="CASE WHEN close < ma20 THEN 1 ELSE 0 END", _dev="CASE WHEN bias5_high OR rsi > 80 THEN 1 ELSE 0 END"),
    stage(sell_factors="_over + _break + _dev"),
    stage(sell_action="CASE WHEN sell_factors >= 2 THEN 'sell' WHEN sell_factors = 1 THEN 'reduce' ELSE 'hold' END"),
)

#: The 60-bar average, or the lowest low of the last 60 bars where there is none.
INVALIDATION = (
    *BOLL_STATE,
    *TREND_INPUTS,
    stage(_support=f"min(low) {over('60 PRECEDING AND 1 PRECEDING')}"),
    stage(level="CASE WHEN ma60 > 0 THEN ma60 ELSE _support END", level_kind="CASE WHEN ma60 > 0 THEN 'ma60' ELSE 'support' END"),
    stage(
        invalidation="CASE WHEN level IS NULL THEN 'unknown' WHEN close < level THEN 'broken' WHEN close < 1.03 * level THEN 'near_above' ELSE 'safe' END",
        distance_pct="CASE WHEN level_kind = 'ma60' THEN (close - level) / nullif(level, 0) * 100 ELSE (close - level) / nullif(close, 0) * 100 END",
    ),
)

JUDGMENT = (
    *HEALTH,
    stage(
        judgment="CASE WHEN close < ma60 THEN 'invalid' WHEN trend_stage IN ('broken', 'weakening') THEN 'down' WHEN trend_stage IN ('near_break', 'pullback') THEN 'transition' WHEN trend_stage IN ('high_dull', 'accelerating', 'advancing', 'starting') THEN CASE WHEN health >= 65 THEN 'strong_up' WHEN health >= 50 THEN 'weak_up' ELSE 'transition' END ELSE 'unknown' END",
        sample_rank="CASE WHEN n_bars >= 250 THEN 3 WHEN n_bars >= 120 THEN 2 ELSE 1 END",
    ),
    stage(confidence="CASE sample_rank WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"),
)

#: Over bars with the weekly index as of each day and the lines of the moving-average oscillator. The floor of
#: the turnover is that of the home market; the other market's is 1.3 times the volume and 30 million.
TURNOVER, VOLUME_TIMES = 100_000_000, 1.5
TRIGGERS = (
    *JUDGMENT,
    stage(_neck=f"max(high) {over('30 PRECEDING AND 6 PRECEDING')}", direction="CASE WHEN plus_di > minus_di THEN 'bullish' WHEN plus_di < minus_di THEN 'bearish' ELSE 'none' END"),
    stage(_trigger="CASE WHEN direction = 'bullish' THEN _neck + 0.3 * atr14 ELSE _neck - 0.3 * atr14 END", _body="abs(close - open) >= 0.3 * atr14"),
    stage(
        price_check="""CASE WHEN _trigger IS NULL OR direction = 'none' THEN 'unknown'
 WHEN direction = 'bullish' AND close >= _trigger AND least(open, close) > _neck AND _body THEN 'pass'
 WHEN direction = 'bearish' AND close <= _trigger AND greatest(open, close) < _neck AND _body THEN 'pass' ELSE 'pending' END""",
        trend_check="""CASE WHEN weekly_adx IS NULL OR weekly_plus_di IS NULL OR weekly_minus_di IS NULL THEN 'unknown'
 WHEN weekly_adx >= 25 AND direction = 'bullish' AND weekly_plus_di > weekly_minus_di THEN 'pass'
 WHEN weekly_adx >= 25 AND direction = 'bearish' AND weekly_minus_di > weekly_plus_di THEN 'pass' ELSE 'pending' END""",
        volume_check=f"CASE WHEN volume_ratio IS NULL THEN 'unknown' WHEN volume_ratio >= {VOLUME_TIMES} AND (amount IS NULL OR amount >= {TURNOVER}) THEN 'pass' ELSE 'pending' END",
        momentum_check="""CASE WHEN macd IS NULL OR macd_signal IS NULL OR rsi IS NULL OR direction = 'none' THEN 'unknown'
 WHEN direction = 'bullish' AND macd >= macd_signal AND rsi BETWEEN 40 AND 70 THEN 'pass'
 WHEN direction = 'bearish' AND macd <= macd_signal AND rsi BETWEEN 30 AND 60 THEN 'pass' ELSE 'pending' END""",
    ),
    stage(passed="CASE price_check WHEN 'pass' THEN 1 ELSE 0 END + CASE trend_check WHEN 'pass' THEN 1 ELSE 0 END + CASE volume_check WHEN 'pass' THEN 1 ELSE 0 END + CASE momentum_check WHEN 'pass' THEN 1 ELSE 0 END"),
    stage(execution="CASE WHEN judgment = 'invalid' THEN 'invalid' WHEN _neck IS NULL OR direction = 'none' THEN 'unavailable' WHEN passed = 4 THEN 'triggered' ELSE 'pending' END"),
    stage(
        display_mode="CASE WHEN execution = 'invalid' THEN 'blocked' WHEN execution = 'unavailable' THEN 'unavailable' WHEN direction = 'bearish' THEN 'levels_only' WHEN confidence = 'high' AND execution = 'triggered' THEN 'full_targets' WHEN confidence = 'high' AND execution = 'pending' THEN 'core_targets' WHEN confidence = 'medium' AND execution = 'pending' THEN 'conditional_range' WHEN confidence = 'medium' AND execution = 'triggered' THEN 'core_targets' WHEN confidence = 'low' AND execution = 'pending' THEN 'conditional_range' ELSE 'unavailable' END",
        action="CASE WHEN judgment IN ('invalid', 'down') OR direction = 'bearish' THEN 'risk_control' WHEN execution = 'unavailable' THEN 'unavailable' WHEN execution = 'pending' THEN 'wait_for_confirmation' WHEN execution = 'triggered' AND confidence IN ('high', 'medium') AND judgment IN ('strong_up', 'weak_up') THEN 'follow' ELSE 'unavailable' END",
    ),
)
ALIGNMENT = (
    *JUDGMENT,
    stage(posture="CASE WHEN close < ma60 THEN 'break' WHEN close > ma20 AND ma20_dir = 'up' THEN 'constructive' WHEN close <= ma20 OR ma20_dir = 'down' THEN 'weak' ELSE 'unknown' END", weekly_side="CASE weekly_trend WHEN 'up' THEN 'up' WHEN 'down' THEN 'down' WHEN 'ranging' THEN 'range' ELSE 'unknown' END"),
    stage(
        alignment="""CASE WHEN weekly_side = 'up' AND posture = 'constructive' AND judgment IN ('strong_up', 'weak_up') THEN 'aligned_up'
 WHEN weekly_side = 'down' AND posture IN ('weak', 'break') AND judgment IN ('down', 'invalid') THEN 'aligned_down'
 WHEN weekly_side = 'range' AND posture IN ('weak', 'break') AND judgment IN ('down', 'invalid') THEN 'daily_break_weekly_range'
 WHEN weekly_side = 'down' AND posture = 'constructive' AND judgment NOT IN ('down', 'invalid') THEN 'daily_repair_weekly_weak'
 WHEN weekly_side = 'unknown' OR posture = 'unknown' THEN 'unknown' ELSE 'mixed' END"""
    ),
)

#: The index path: averages need full windows, and a missing 60-bar average counts as broken.
INDEX_STAGE = (
    stage(_n20=f"count(*) {last(20)}", _n60=f"count(*) {last(60)}", _a20=f"avg(close) {last(20)}", _a60=f"avg(close) {last(60)}"),
    stage(ma20="CASE WHEN _n20 = 20 THEN _a20 END", ma60="CASE WHEN _n60 = 60 THEN _a60 END"),
    stage(above20="coalesce(close >= ma20, false)", above60="coalesce(close >= ma60, false)", _p60=f"lag(ma60, 5) {PREV}"),
    stage(index_stage="CASE WHEN NOT above60 AND NOT above20 THEN 'broken' WHEN NOT above60 THEN 'near_break' WHEN NOT above20 THEN 'pullback' WHEN ma60 > _p60 THEN 'advancing' ELSE 'starting' END"),
)


def strength(stage_column: str) -> str:
    return f"CASE {stage_column} WHEN 'accelerating' THEN 2 WHEN 'advancing' THEN 2 WHEN 'starting' THEN 1 WHEN 'high_dull' THEN 1 WHEN 'pullback' THEN 0 WHEN 'ranging' THEN 0 WHEN 'weakening' THEN -1 WHEN 'near_break' THEN -1 ELSE -2 END"


ADVICE = (
    *BOLL_STATE,
    *HEALTH,
    stage(
        bias_text="CASE WHEN bias5_high THEN 'bias_new_high' WHEN bias5_low THEN 'bias_new_low' WHEN abs(bias5) > 5 THEN 'bias_wide' ELSE 'bias_normal' END",
        boll_text="CASE WHEN boll_state = 'unknown' THEN 'boll_unknown' WHEN close > boll_upper THEN concat('above_', boll_state) WHEN close < boll_lower THEN concat('below_', boll_state) ELSE concat('inside_', boll_state) END",
        rsi_text="CASE WHEN rsi IS NULL THEN 'rsi_unknown' WHEN rsi > 80 THEN 'rsi_very_hot' WHEN rsi > 70 THEN 'rsi_hot' WHEN rsi < 20 THEN 'rsi_very_cold' WHEN rsi < 30 THEN 'rsi_cold' ELSE 'rsi_neutral' END",
    ),
)

STRATEGY = (
    *INVALIDATION,
    STAGE,
    stage(_near="CASE WHEN close <= 1.05 * ma60 THEN 1 ELSE 0 END", _flat="CASE WHEN ma20_dir IN ('flat', 'up') THEN 1 ELSE 0 END", _rng5=f"max(high) {last(5)} - min(low) {last(5)}", _rng20=f"max(high) {last(20)} - min(low) {last(20)}", _low=f"min(low) {over('60 PRECEDING AND 1 PRECEDING')}"),
    stage(bottom_score="_near + _flat + CASE WHEN _rng5 < 0.4 * _rng20 THEN 1 ELSE 0 END + CASE WHEN close > 0.99 * _low THEN 1 ELSE 0 END + CASE WHEN close > ma5 THEN 1 ELSE 0 END"),
    stage(bottoming="CASE WHEN bottom_score >= 5 THEN 'strengthened' WHEN bottom_score >= 4 THEN 'candidate' WHEN bottom_score >= 3 THEN 'watch' ELSE 'none' END"),
    stage(staged_entry="coalesce(bottoming IN ('candidate', 'strengthened') AND trend_stage <> 'broken' AND close >= ma5 AND level IS NOT NULL, false)"),
)

#: A pattern is a neckline (the highest high 30 to 6 bars back) once there are 30 bars; without one only the swing counts.
TARGET = (
    *TREND_INPUTS,
    stage(_lo=f"min(low) {last(60)}", _hi=f"max(high) {last(60)}", _neck0=f"max(high) {over('30 PRECEDING AND 6 PRECEDING')}", _base=f"min(low) {over('30 PRECEDING AND 1 PRECEDING')}", _adx1=f"lag(adx) {PREV}"),
    stage(bull="plus_di > minus_di", daily_trend="CASE WHEN adx > 25 AND plus_di > minus_di THEN 'up' WHEN adx > 25 AND plus_di < minus_di THEN 'down' ELSE 'ranging' END", _neck="CASE WHEN n_bars >= 30 THEN _neck0 END"),
    stage(fib_1000="_hi", fib_1272="_hi + (_hi - _lo) * 0.272", fib_1618="_hi + (_hi - _lo) * 0.618", measured="CASE WHEN bull THEN _neck + abs(_neck - _base) ELSE _neck - abs(_neck - _base) END"),
    stage(
        converged="coalesce(abs(fib_1272 - measured) / nullif(greatest(abs(fib_1272), abs(measured)), 0) <= 0.03, false)",
        conservative="CASE WHEN bull AND _neck IS NOT NULL THEN least(measured, fib_1000) WHEN bull THEN fib_1000 WHEN _neck IS NOT NULL THEN measured ELSE close * 0.95 END",
        base_target="CASE WHEN _neck IS NOT NULL THEN measured WHEN bull THEN fib_1272 ELSE close * 0.90 END",
        aggressive_raw="CASE WHEN bull AND _neck IS NOT NULL THEN measured * 1.3 WHEN bull THEN fib_1618 WHEN _neck IS NOT NULL THEN measured * 0.85 ELSE close * 0.85 END",
    ),
    stage(aggressive="least(aggressive_raw, 1.5 * close)", is_far="aggressive_raw > 1.5 * close"),
    stage(trigger="CASE WHEN bull THEN _neck + 0.3 * atr14 ELSE _neck - 0.3 * atr14 END", stop="CASE WHEN bull THEN _neck - 1.5 * atr14 ELSE _neck + 1.5 * atr14 END"),
    stage(profit_risk="abs(conservative - trigger) / nullif(abs(trigger - stop), 0)", right_side="CASE WHEN bull THEN conservative > trigger ELSE conservative < trigger END"),
    stage(passes_filter="coalesce(profit_risk >= 1.5 AND right_side, false)"),
    stage(
        resonance_points="CASE WHEN (weekly_trend = 'up') = bull AND weekly_trend <> 'unknown' THEN 10 ELSE 5 END",
        pattern_points="CASE WHEN _neck IS NULL THEN 3 WHEN profit_risk >= 2 THEN 8 ELSE 5 END",
        adx_points="CASE WHEN adx > 30 THEN 10 WHEN adx > 25 THEN 7 WHEN adx > 20 THEN 4 ELSE 0 END",
        momentum_points="CASE WHEN rsi BETWEEN 40 AND 70 THEN 8 ELSE 4 END",
        _mult="(CASE WHEN adx > _adx1 THEN 0.85 WHEN adx < _adx1 THEN 1.25 ELSE 1.0 END) * (CASE WHEN rsi > 65 THEN 1.1 WHEN rsi < 40 THEN 0.9 ELSE 1.0 END)",
    ),
    stage(score="CAST(0.30 * resonance_points + 0.20 * pattern_points + 0.15 * adx_points + 0.05 * momentum_points + 0.10 * CASE WHEN converged THEN 10 ELSE 0 END AS DOUBLE)"),
    stage(
        target_confidence="CASE WHEN score >= 8 THEN CASE WHEN is_far THEN 'medium' ELSE 'high' END WHEN score >= 6 THEN 'medium' WHEN score >= 4 THEN 'low' ELSE 'watch' END",
        eta_low="CASE WHEN atr14 > 0 THEN abs(conservative - close) / atr14 * 1.5 * _mult ELSE 0 END",
        eta_high="CASE WHEN atr14 > 0 THEN abs(conservative - close) / atr14 * 2.0 * _mult ELSE 0 END",
    ),
    stage(target_status="CASE WHEN n_bars < 60 THEN 'short_history' WHEN atr14 IS NULL OR adx IS NULL THEN 'no_indicator' WHEN _neck IS NULL THEN 'no_pattern' WHEN NOT coalesce(right_side, false) THEN 'wrong_side' WHEN NOT passes_filter THEN 'poor_ratio' ELSE 'ok' END"),
)
