"""Trend operators against plain computations of what a day could know."""

from __future__ import annotations

import os
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import recurrences as rec
from ledgerlens.operators import structure as st
from ledgerlens.operators import trend as tr
from ledgerlens.plans import market
from ledgerlens.plans.stages import apply

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def daily(spark):
    bars = market.QUERIES["q_b00_bars"].run(spark, SF).toPandas()
    bars["dt"] = pd.to_datetime(bars["dt"])
    return {s: g.sort_values("dt").reset_index(drop=True) for s, g in bars.groupby("symbol")}


def weeks_until(g: pd.DataFrame, k: int) -> pd.DataFrame:
    """Weekly bars of the days up to k; the last one may be unfinished."""
    d = g.iloc[: k + 1]
    friday = d.dt + pd.to_timedelta((4 - d.dt.dt.weekday) % 7, unit="D")
    return d.groupby(friday).agg(high=("high", "max"), low=("low", "min"), close=("close", "last"))


def weekly_trend(w: pd.DataFrame) -> str:
    if len(w) < 20:
        return "unknown"
    c = w.close
    m5, m10, m20 = (c.rolling(n, min_periods=1).mean() for n in (5, 10, 20))
    above, below = ((c > m5) & (c > m10)).iloc[-6:].sum(), ((c < m5) & (c < m10)).iloc[-6:].sum()
    s5, s10 = m5.iloc[-1] / m5.iloc[-4] - 1, m10.iloc[-1] / m10.iloc[-4] - 1
    cross = ((c - m5) * (c - m5).shift() < 0) | ((c - m10) * (c - m10).shift() < 0)
    if above >= 5 and m5.iloc[-1] > m10.iloc[-1] > m20.iloc[-1] and s5 > 0 and s10 > 0:
        return "up"
    if below >= 5 and m5.iloc[-1] < m10.iloc[-1] < m20.iloc[-1] and s5 < 0 and s10 < 0:
        return "down"
    return "ranging" if cross.iloc[-10:].sum() >= 3 or abs(m5.iloc[-1] - m10.iloc[-1]) / m10.iloc[-1] < 0.02 else "repairing"


def directional(w: pd.DataFrame) -> tuple[float, float, float]:
    pc = w.close.shift()
    tr_ = pd.concat([w.high - w.low, (w.high - pc).abs(), (w.low - pc).abs()], axis=1).max(axis=1)
    up, down = w.high.diff().clip(lower=0).fillna(0), (-w.low.diff()).clip(lower=0).fillna(0)
    plus = up.where(up > down, 0.0)
    minus = down.where(down > plus, 0.0)
    mean = lambda x: x.rolling(14, min_periods=1).mean()
    p, m = 100 * mean(plus) / mean(tr_), 100 * mean(minus) / mean(tr_)
    dx = (100 * (p - m).abs() / (p + m)).fillna(0)
    return p.iloc[-1], m.iloc[-1], mean(dx).iloc[-1]


@needs_tables
def test_a_day_sees_no_later_one_of_its_week(spark, daily):
    got = market.triggered((), "weekly_trend", "weekly_adx", "weekly_plus_di", "weekly_minus_di").run(spark, SF).toPandas()
    got = {(r.symbol, pd.Timestamp(r.dt)): r for r in got.itertuples()}
    seen = set()
    for symbol, g in daily.items():
        for k in [*range(0, len(g), 7), len(g) - 1]:
            w, r = weeks_until(g, k), got[symbol, g.dt[k]]
            assert r.weekly_trend == weekly_trend(w), (symbol, k)
            seen.add(r.weekly_trend)
            p, m, a = directional(w)
            assert np.allclose([r.weekly_plus_di, r.weekly_minus_di, r.weekly_adx], [p, m, a], equal_nan=True), (symbol, k)
    assert {"unknown", "ranging"} <= seen


def bars_of(spark, closes, high=0.2, low=0.2):
    start = date(2026, 1, 1)
    data = [("X", start + timedelta(days=i), c - 0.1, c + high, c - low, c, 1000, 1e9) for i, c in enumerate(closes)]
    return spark.createDataFrame(data, "symbol string, dt date, open double, high double, low double, close double, volume long, amount double")


def pivots(spark, closes, pct=0.05):
    rows = rec.zigzag(bars_of(spark, [float(c) for c in closes]), pct).orderBy("pivot_no").collect()
    return [((r.dt - date(2026, 1, 1)).days, r.price, r.kind) for r in rows]


def test_zigzag_cases(spark):
    assert pivots(spark, [10, 10]) == []
    assert pivots(spark, [10, 10.1, 10.2]) == [(0, 10.0, "valley")]  # nothing moved: bar 0 alone
    assert pivots(spark, [10, 11, 12]) == [(0, 10.0, "valley"), (2, 12.0, "peak")]
    assert pivots(spark, [10, 9, 9.2, 8.8]) == [(0, 10.0, "peak"), (3, 8.8, "valley")]
    # small moves before the first turn do not shift the first pivot from bar 0
    assert pivots(spark, [10, 9.8, 10.6, 12, 11.9, 11, 11.5, 11.7]) == [(0, 10.0, "valley"), (3, 12.0, "peak"), (5, 11.0, "valley"), (7, 11.7, "peak")]


def test_channel_as_of_each_bar(spark):
    rising = [10 + 0.04 * i for i in range(60)]
    flat = [10.0] * 60
    falling = [10 - 0.06 * i for i in range(60)]
    steep = [10 * 1.03**i for i in range(60)]
    for closes, want in ((rising, "box"), (flat, "box"), (falling, "down_channel"), (steep, "box"), ([10 + 0.08 * i for i in range(60)], "up_channel")):
        out = apply(bars_of(spark, closes), st.CHANNEL).orderBy("dt").collect()
        assert [r.channel for r in out[:39]] == ["none"] * 39
        x = np.arange(40)
        for k in (39, 50, 59):
            part = np.array(closes[k - 39 : k + 1])
            slope = np.polyfit(x, part, 1)[0] / part.mean()
            expected = "box" if abs(slope) > 0.01 or abs(slope) < 0.005 else "up_channel" if slope > 0 else "down_channel"
            assert out[k].channel == expected
        assert out[39].channel == want or want == "box"


def row(spark, **values):
    given = {
        "symbol": "X", "dt": date(2026, 1, 1), "open": 10.0, "high": 10.6, "low": 9.9, "close": 10.5, "volume": 1, "amount": 2e8, "atr14": 0.4, "volume_ratio": 2.0,
        "weekly_adx": 30.0, "weekly_plus_di": 20.0, "weekly_minus_di": 10.0, "macd": 0.2, "macd_signal": 0.1, "rsi": 55.0, "direction": "bullish", "_neck": 9.8,
        "judgment": "strong_up", "confidence": "high",
    } | values
    kinds = {str: "string", float: "double", int: "long", date: "date"}
    schema = ", ".join(f"`{k}` {kinds[type(v)] if v is not None else 'double'}" for k, v in given.items())
    return spark.createDataFrame([tuple(given.values())], schema)


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ({}, ("pass", "pass", "pass", "pass", "triggered", "full_targets", "follow")),
        ({"amount": 9e7}, ("pass", "pass", "pending", "pass", "pending", "core_targets", "wait_for_confirmation")),
        ({"amount": None}, ("pass", "pass", "pass", "pass", "triggered", "full_targets", "follow")),
        ({"volume_ratio": None}, ("pass", "pass", "unknown", "pass", "pending", "core_targets", "wait_for_confirmation")),
        ({"macd": 0.0}, ("pass", "pass", "pass", "pending", "pending", "core_targets", "wait_for_confirmation")),
        ({"macd": None}, ("pass", "pass", "pass", "unknown", "pending", "core_targets", "wait_for_confirmation")),
        ({"rsi": 71.0}, ("pass", "pass", "pass", "pending", "pending", "core_targets", "wait_for_confirmation")),
        ({"weekly_adx": 24.0}, ("pass", "pending", "pass", "pass", "pending", "core_targets", "wait_for_confirmation")),
        ({"weekly_minus_di": 25.0}, ("pass", "pending", "pass", "pass", "pending", "core_targets", "wait_for_confirmation")),
        ({"open": 10.45}, ("pending", "pass", "pass", "pass", "pending", "core_targets", "wait_for_confirmation")),
        ({"judgment": "down"}, ("pass", "pass", "pass", "pass", "triggered", "full_targets", "risk_control")),
        ({"judgment": "invalid"}, ("pass", "pass", "pass", "pass", "invalid", "blocked", "risk_control")),
        ({"direction": "bearish"}, ("pending", "pending", "pass", "pending", "pending", "levels_only", "risk_control")),
    ],
)
def test_trigger_checks(spark, values, want):
    """The documented decision tables, one row at a time."""
    checks = tr.TRIGGERS[len(tr.JUDGMENT) + 1 :]
    r = apply(row(spark, **values), checks).first()
    assert (r.price_check, r.trend_check, r.volume_check, r.momentum_check, r.execution, r.display_mode, r.action) == want


def test_health_points(spark):
    given = {"weekly_trend": "up", "ma20_dir": "up", "ma60_dir": "up", "close": 12.0, "ma20": 11.0, "ma60": 10.0, "channel": "up_channel", "volume_score": 9, "boll_state": "opening", "rsi": 60.0, "bias5": 2.0}
    kinds = {str: "string", float: "double", int: "int"}

    def health(**values):
        v = given | values
        df = spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {kinds[type(x)]}" for k, x in v.items()))
        points = next(i for i, s in enumerate(tr.HEALTH) if "_pts" in s.columns)
        r = apply(df, tr.HEALTH[points:]).first()
        return r.health, r.health_grade

    assert health() == (25 + 20 + 12 + 9 + 7, "B")
    assert health(channel="none") == (66, "B")
    assert health(weekly_trend="repairing", ma20_dir="down", channel="box", volume_score=4, boll_state="normal", rsi=80.0, bias5=6.0) == (16 + 15, "C")
    assert health(weekly_trend="ranging", ma20_dir="flat", close=9.0, channel="none", volume_score=4, boll_state="normal") == (32, "D")


