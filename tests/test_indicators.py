"""Indicators against independent pandas versions, and their edge cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import indicators as ind
from ledgerlens.operators import recurrences as rec
from ledgerlens.operators import structure as st
from ledgerlens.plans.stages import apply

SCHEMA = "symbol string, dt date, open double, high double, low double, close double, volume long, amount double"


def walk(n, seed=42, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    days = pd.bdate_range("2024-01-01", periods=n).date
    return pd.DataFrame({"symbol": symbol, "dt": days, "open": close * 0.99, "high": close * (1 + rng.uniform(0, 0.03, n)), "low": close * (1 - rng.uniform(0, 0.03, n)), "close": close, "volume": rng.integers(1, 1000, n), "amount": close * 1000})


@pytest.fixture(scope="module")
def bars():
    return pd.concat([walk(150), walk(40, 7, "B"), walk(3, 8, "C")])


def run(spark, bars, stages, *cols):
    out = apply(spark.createDataFrame(bars, SCHEMA), stages).select("symbol", "dt", *cols).toPandas()
    return out.sort_values(["symbol", "dt"]).reset_index(drop=True)


def per_symbol(bars, f):
    return np.concatenate([np.asarray(f(g.reset_index(drop=True)), float) for _, g in bars.groupby("symbol")])


def same(got, want):
    assert np.allclose(got.astype(float), want, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_averages_and_bands(spark, bars):
    out = run(spark, bars, (ind.sma(20), *ind.bollinger()), "sma20", "boll_upper")
    same(out.sma20, per_symbol(bars, lambda g: g.close.rolling(20, min_periods=1).mean()))
    same(out.boll_upper, per_symbol(bars, lambda g: g.close.rolling(20, min_periods=1).mean() + 2 * g.close.rolling(20, min_periods=1).std()))


def test_rsi(spark, bars):
    def f(g):
        d = g.close.diff()
        gain, loss = d.clip(lower=0).fillna(0).rolling(14, min_periods=1).mean(), (-d).clip(lower=0).fillna(0).rolling(14, min_periods=1).mean()
        return 100 - 100 / (1 + gain / loss.replace(0, np.nan))

    same(run(spark, bars, ind.rsi(), "rsi").rsi, per_symbol(bars, f))


def test_atr_and_adx(spark, bars):
    def tr(g):
        p = g.close.shift()
        return pd.concat([g.high - g.low, (g.high - p).abs(), (g.low - p).abs()], axis=1).max(axis=1)

    def adx(g):
        up, down = g.high.diff().clip(lower=0).fillna(0), (-g.low.diff()).clip(lower=0).fillna(0)
        plus = up.where(up > down, 0)
        minus = down.where(down > plus, 0)
        base = tr(g).rolling(14, min_periods=1).mean()
        p, m = 100 * plus.rolling(14, min_periods=1).mean() / base, 100 * minus.rolling(14, min_periods=1).mean() / base
        return (100 * (p - m).abs() / (p + m).replace(0, np.nan)).fillna(0).rolling(14, min_periods=1).mean()

    out = run(spark, bars, ind.adx(), "adx", "tr")
    same(out.tr, per_symbol(bars, tr))
    same(out.adx, per_symbol(bars, adx))


def test_cci_and_williams(spark, bars):
    def cci(g):
        tp = (g.high + g.low + g.close) / 3
        mad = tp.rolling(20, min_periods=1).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
        return (tp - tp.rolling(20, min_periods=1).mean()) / (0.015 * mad).replace(0, np.nan)

    out = run(spark, bars, (*ind.cci(), *ind.williams_r()), "cci", "williams_r")
    assert np.allclose(out.cci.astype(float)[2:150], per_symbol(bars, cci)[2:150], rtol=1e-6)
    hh = lambda g: -100 * (g.high.rolling(14, min_periods=1).max() - g.close) / (g.high.rolling(14, min_periods=1).max() - g.low.rolling(14, min_periods=1).min())
    same(out.williams_r, per_symbol(bars, hh))


def test_exponential_averages(spark, bars):
    df = spark.createDataFrame(bars, SCHEMA)
    out = rec.ema(df).toPandas().sort_values(["symbol", "dt"])
    same(out.ema12, per_symbol(bars, lambda g: g.close.ewm(span=12, adjust=False).mean()))
    m = rec.macd(df).toPandas().sort_values(["symbol", "dt"])

    def hist(g):
        line = g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()
        return line - line.ewm(span=9, adjust=False).mean()

    same(m.macd_hist, per_symbol(bars, hist))


def test_bias_needs_full_windows_and_history(spark, bars):
    out = run(spark, bars, ind.bias(5), "bias5", "bias5_high", "bias5_rank")
    same(out.bias5, per_symbol(bars, lambda g: (g.close / g.close.rolling(5).mean() - 1) * 100))
    assert (out[out.symbol == "B"].bias5_rank == 50).all() and not out[out.symbol == "C"].bias5_high.any()


def test_flat_prices_give_no_rsi_and_a_doji(spark):
    g = walk(30)
    for c in ("open", "high", "low", "close"):
        g[c] = 5.0
    out = run(spark, g, (*ind.rsi(), *ind.CANDLE), "rsi", "is_doji")
    assert out.rsi.isna().all() and not out.is_doji.any()


def test_swings_by_definition(spark, bars):
    out = run(spark, bars, st.swings("low", 3, 3), "low", "swing_low")
    for _, g in out.groupby("symbol"):
        x = g.low.to_numpy()
        for i, flag in enumerate(g.swing_low):
            want = 3 <= i < len(x) - 3 and x[i] < x[i - 3 : i].min() and x[i] < x[i + 1 : i + 4].min()
            assert flag == want


def test_zigzag_alternates(spark, bars):
    out = rec.zigzag(spark.createDataFrame(bars, SCHEMA), 0.05).toPandas().sort_values(["symbol", "pivot_no"])
    for _, g in out.groupby("symbol"):
        assert all(a != b for a, b in zip(g.kind, g.kind[1:], strict=False))
        assert all(abs(b / a - 1) >= 0.0499 for a, b in zip(g.price[:-2], g.price[1:-1], strict=False))
