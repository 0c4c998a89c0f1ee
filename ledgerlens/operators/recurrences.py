"""Indicators defined by a recurrence along each symbol's bars.

A symbol's bars are one group of at most its trading days, so each group is small; symbols are
spread over the cluster. Values go to Python as one Arrow table per symbol.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _ema(x: np.ndarray, span: int) -> np.ndarray:
    """e = a x + (1 - a) e from the first value on."""
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def ema(bars: DataFrame, spans: tuple[int, ...] = (12, 26)) -> DataFrame:
    """symbol, dt and ema<span> of the close."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt")
        return g[["symbol", "dt"]].assign(**{f"ema{n}": _ema(g["close"].to_numpy(float), n) for n in spans})

    cols = "".join(f", ema{n} double" for n in spans)
    return bars.select("symbol", "dt", "close").groupBy("symbol").applyInPandas(run, f"symbol string, dt date{cols}")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """symbol, dt, macd, macd_signal, macd_hist (line minus signal) and the histogram's phase."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt")
        x = g["close"].to_numpy(float)
        line = _ema(x, fast) - _ema(x, slow)
        sig = _ema(line, signal)
        return g[["symbol", "dt"]].assign(macd=line, macd_signal=sig, macd_hist=line - sig)

    return bars.select("symbol", "dt", "close").groupBy("symbol").applyInPandas(run, "symbol string, dt date, macd double, macd_signal double, macd_hist double")


def zigzag(bars: DataFrame, min_pct: float = 0.05) -> DataFrame:
    """Pivots of the close: symbol, pivot_no, dt, price, kind (peak or valley).

    The first move of at least `min_pct` from bar 0 names bar 0 a valley or a peak; from then on the running
    extreme is a pivot once the close has turned from it by `min_pct`. The last leg ends at its extreme,
    unless that is the last pivot's bar. If nothing moved so far, bar 0 is the one pivot, a valley. Symbols of
    fewer than three bars have none."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt")
        x, dates = g["close"].to_numpy(float), g["dt"].to_list()
        out: list[tuple[int, str]] = []
        way, extreme = 0, 0
        for i in range(1, len(x) if len(x) >= 3 else 0):
            change = (x[i] - x[extreme]) / x[extreme]
            if way == 0:
                if abs(change) >= min_pct:
                    way = 1 if change > 0 else -1
                    out.append((extreme, "valley" if way > 0 else "peak"))
                    extreme = i
            elif way * change > 0:
                extreme = i
            elif -way * change >= min_pct:
                out.append((extreme, "peak" if way > 0 else "valley"))
                way, extreme = -way, i
        if out and extreme != out[-1][0]:
            out.append((extreme, "peak" if x[extreme] > x[out[-1][0]] else "valley"))
        elif not out and len(x) >= 3:
            out.append((extreme, "valley"))
        at = [i for i, _ in out]
        dts = pd.Series([dates[i] for i in at], dtype=object)
        return pd.DataFrame({"symbol": pd.Series([g["symbol"].iloc[0]] * len(at), dtype=object), "pivot_no": np.arange(len(at)), "dt": dts, "price": x[at] if at else np.empty(0), "kind": pd.Series([k for _, k in out], dtype=object)})

    return bars.select("symbol", "dt", "close").groupBy("symbol").applyInPandas(run, "symbol string, pivot_no long, dt date, price double, kind string")
