"""Technical indicators as window expressions per symbol (I01-I19), and the bar operators that only need windows.

Averages start with the first bar (a window that isn't full yet averages what it has) unless a
strict count is asked for. Missing values are NULL, never NaN.
"""

from __future__ import annotations

from ..plans.stages import Stage, last, over, stage

PREV = over()


def strict(expr: str, n: int) -> str:
    """`expr` over the last n rows, NULL until there are n."""
    return f"CASE WHEN count(*) {last(n)} = {n} THEN {expr} {last(n)} END"


def sma(period: int, column: str = "close", name: str | None = None) -> Stage:
    return stage(**{name or f"sma{period}": f"avg({column}) {last(period)}"})


TRUE_RANGE = (
    stage(prev_close=f"lag(close) {PREV}"),
    stage(tr="greatest(high - low, abs(high - prev_close), abs(low - prev_close))"),
)


def atr(period: int = 14) -> tuple[Stage, ...]:
    """A plain mean of the true range, not a smoothed one."""
    return (*TRUE_RANGE, stage(**{f"atr{period}": f"avg(tr) {last(period)}"}))


def adx(period: int = 14) -> tuple[Stage, ...]:
    """The directional movements are filtered one after the other: the second sees the first's result."""
    return (
        *TRUE_RANGE,
        stage(up=f"high - lag(high) {PREV}", down=f"lag(low) {PREV} - low"),
        stage(up="CASE WHEN up > 0 THEN up ELSE 0 END", down="CASE WHEN down > 0 THEN down ELSE 0 END"),
        stage(plus_dm="CASE WHEN up > down THEN up ELSE 0 END"),
        stage(minus_dm="CASE WHEN down > plus_dm THEN down ELSE 0 END"),
        stage(tr_avg=f"avg(tr) {last(period)}", plus_avg=f"avg(plus_dm) {last(period)}", minus_avg=f"avg(minus_dm) {last(period)}"),
        stage(plus_di="100 * plus_avg / nullif(tr_avg, 0)", minus_di="100 * minus_avg / nullif(tr_avg, 0)"),
        stage(dx="coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0)"),
        stage(adx=f"avg(dx) {last(period)}"),
    )


def rsi(period: int = 14, column: str = "close", name: str = "rsi") -> tuple[Stage, ...]:
    """Means of gains and losses; NULL where there is no loss."""
    return (
        stage(_d=f"{column} - lag({column}) {PREV}"),
        stage(_gain="CASE WHEN _d > 0 THEN _d ELSE 0 END", _loss="CASE WHEN _d < 0 THEN -_d ELSE 0 END"),
        stage(_ag=f"avg(_gain) {last(period)}", _al=f"avg(_loss) {last(period)}"),
        stage(**{name: "100 - 100 / (1 + _ag / nullif(_al, 0))"}),
    )


def cci(period: int = 20) -> tuple[Stage, ...]:
    """The mean deviation is taken around each window's own mean."""
    return (
        stage(tp="(high + low + close) / 3"),
        stage(tp_mean=f"avg(tp) {last(period)}", tps=(f"collect_list(tp) {last(period)}", f"list(tp) {last(period)}")),
        stage(mad=("aggregate(tps, 0D, (a, x) -> a + abs(x - tp_mean)) / size(tps)", "list_sum(list_transform(tps, lambda x: abs(x - tp_mean))) / len(tps)")),
        stage(cci="(tp - tp_mean) / nullif(0.015 * mad, 0)"),
    )


def williams_r(period: int = 14) -> tuple[Stage, ...]:
    return (stage(hh=f"max(high) {last(period)}", ll=f"min(low) {last(period)}"), stage(williams_r="-100 * (hh - close) / nullif(hh - ll, 0)"))


def stoch_rsi(period: int = 14, k: int = 3, d: int = 3) -> tuple[Stage, ...]:
    return (
        *rsi(period),
        stage(_lo=f"min(rsi) {last(period)}", _hi=f"max(rsi) {last(period)}"),
        stage(_raw="coalesce(100 * (rsi - _lo) / nullif(_hi - _lo, 0), 0)"),
        stage(stoch_k=f"avg(_raw) {last(k)}"),
        stage(stoch_d=f"avg(stoch_k) {last(d)}"),
    )


OBV = (
    stage(_dc=f"close - lag(close) {PREV}"),
    stage(obv=f"CAST(sum(CASE WHEN _dc > 0 THEN volume WHEN _dc < 0 THEN -volume ELSE 0 END) {over('UNBOUNDED PRECEDING AND CURRENT ROW')} AS BIGINT)"),
)


def bollinger(period: int = 20, width: float = 2.0) -> tuple[Stage, ...]:
    return (
        stage(boll_mid=f"avg(close) {last(period)}", boll_sd=f"stddev_samp(close) {last(period)}"),
        stage(boll_upper=f"boll_mid + {width} * boll_sd", boll_lower=f"boll_mid - {width} * boll_sd"),
    )


def bias(period: int, history: int = 120, least: int = 60) -> tuple[Stage, ...]:
    """Deviation from a strict average in per cent; extreme if beyond all of the `history` values before."""
    b = f"bias{period}"
    past = over(f"{history} PRECEDING AND 1 PRECEDING")
    return (
        stage(**{f"_m{period}": strict("avg(close)", period)}),
        stage(**{b: f"(close / nullif(_m{period}, 0) - 1) * 100"}),
        stage(_n=f"count({b}) {past}", _hi=f"max({b}) {past}", _lo=f"min({b}) {past}", _past=(f"collect_list({b}) {past}", f"list({b}) FILTER ({b} IS NOT NULL) {past}")),
        stage(
            **{
                f"{b}_high": f"CASE WHEN _n >= {least} AND {b} IS NOT NULL THEN {b} > _hi ELSE false END",
                f"{b}_low": f"CASE WHEN _n >= {least} AND {b} IS NOT NULL THEN {b} < _lo ELSE false END",
                f"{b}_rank": (f"CASE WHEN _n >= {least} AND {b} IS NOT NULL THEN 100D * size(filter(_past, x -> x < {b})) / _n ELSE 50D END", f"CASE WHEN _n >= {least} AND {b} IS NOT NULL THEN 100.0::DOUBLE * len(list_filter(_past, lambda x: x < {b})) / _n ELSE 50.0::DOUBLE END"),
            }
        ),
    )


BOLL_STATE = (
    *bollinger(),
    stage(boll_width="(boll_upper - boll_lower) / nullif(boll_mid, 0)"),
    stage(_ref=f"avg(boll_width) {over('5 PRECEDING AND 1 PRECEDING')}", _refs=f"count(boll_width) {over('5 PRECEDING AND 1 PRECEDING')}"),
    stage(boll_state="CASE WHEN _refs < 5 OR boll_width IS NULL THEN 'unknown' WHEN boll_width > 1.2 * _ref THEN 'opening' WHEN boll_width < 0.8 * _ref THEN 'narrowing' ELSE 'normal' END"),
)

CANDLE = (
    *atr(14),
    stage(body="abs(close - open)", upper_shadow="high - greatest(open, close)", lower_shadow="least(open, close) - low", bar_range="high - low"),
    stage(
        body_pct="body / nullif(close, 0) * 100",
        body_atr="body / nullif(atr14, 0)",
        is_doji="coalesce(body / nullif(bar_range, 0) < 0.1, false)",
        long_upper="coalesce(upper_shadow / nullif(bar_range, 0) > 0.45, false)",
        long_lower="coalesce(lower_shadow / nullif(bar_range, 0) > 0.45, false)",
    ),
)


def ma_direction(column: str, lookback: int = 5, flat: float = 0.005, name: str | None = None) -> tuple[Stage, ...]:
    r = f"_{column}_chg"
    return (
        stage(**{r: f"{column} / nullif(lag({column}, {lookback}) {PREV}, 0) - 1"}),
        stage(**{name or f"{column}_dir": f"CASE WHEN {r} IS NULL THEN 'unknown' WHEN {r} > {flat} THEN 'up' WHEN {r} < -{flat} THEN 'down' ELSE 'flat' END"}),
    )


VOLUME_CONTEXT = (
    stage(
        _vb=f"avg(volume) {over('20 PRECEDING AND 1 PRECEDING')}",
        _vn=f"count(CASE WHEN volume > 0 THEN 1 END) {over('20 PRECEDING AND CURRENT ROW')}",
        _m20=f"avg(close) {last(20)}",
        _pc=f"lag(close) {PREV}",
    ),
    stage(
        volume_ratio="CASE WHEN _vn = 21 THEN volume / nullif(_vb, 0) END",
        volume_side="CASE WHEN _pc IS NULL THEN 'unknown' WHEN close > _pc AND close > _m20 THEN 'bullish' WHEN close < _pc AND close < _m20 THEN 'bearish' ELSE 'mixed' END",
    ),
)

SLOPES = (
    *OBV,
    stage(_do=f"obv - lag(obv) {PREV}"),
    stage(obv_slope=f"CASE WHEN count(_do) {last(5)} = 5 THEN avg(_do) {last(5)} END", price_slope=f"CASE WHEN count(_dc) {last(5)} = 5 THEN avg(_dc) {last(5)} END"),
)
