"""Bars from an event stream: tumbling windows with a watermark, and a per-symbol stage tracker.

Late events within the watermark update their bar; state older than it is dropped, so state
stays bounded by the open windows. The same functions work on a batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_bars(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """symbol, window start, open, high, low, close, volume and amount of events(event_type, ts, value)."""
    keyed = events.withWatermark("ts", late) if events.isStreaming else events
    g = keyed.groupBy(F.col("event_type").alias("symbol"), F.window("ts", every).alias("w"))
    bars = g.agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"),
        F.count("*").alias("volume"),
        F.sum("value").alias("amount"),
    )
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "amount")


_STATE = "ema double, stage string, bars long"
_OUT = "symbol string, bars long, ema double, stage string, changed boolean"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, alpha: float) -> Iterator[pd.DataFrame]:
    ema, stage, n = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(frames)).sort_values("start")
    changed = False
    for close in rows["close"]:
        ema = close if ema is None else alpha * close + (1 - alpha) * ema
        now = "above" if close >= ema else "below"
        changed = changed or (stage is not None and now != stage)
        stage, n = now, n + 1
    state.update((float(ema), stage, n))
    yield pd.DataFrame({"symbol": [key[0]], "bars": [n], "ema": [ema], "stage": [stage], "changed": [changed]})


def track_stage(bars: DataFrame, span: int = 12) -> DataFrame:
    """The exponential average of closes and the side of the last close, kept per symbol across micro-batches."""
    alpha = 2 / (span + 1)

    def run(key, frames, state):
        return _step(key, frames, state, alpha)

    return bars.groupBy("symbol").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
