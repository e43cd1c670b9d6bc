"""Bars, weighted means and zones of a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


NAMES = ["symbol", "type", "start_ts", "end_ts", "duration"]


def live_bars(ticks: DataFrame, symbol: str, ts: str, price: str, every: str = "1 hour", late: str = "10 minutes", volume: str | None = None) -> DataFrame:
    """OHLCV of each window; ticks later than late after the newest are dropped by the watermark."""
    t = ticks.withWatermark(ts, late)
    w = F.window(ts, every)
    out = t.groupBy(F.col(symbol).alias("symbol"), w.alias("w")).agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.sum(volume or price).alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def live_zones(bars: DataFrame, fast: int = 12, slow: int = 26, min_duration: int = 2, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Closed MACD zones of a stream of bars: (symbol, type, start_ts, end_ts, duration).

    The state of a symbol is the two weighted sums, and the sign, start, end and length of the open zone; a zone is
    emitted when the sign changes. Bars of a batch are taken in order of time; a bar that is not after the last one taken comes
    too late and is left out. With idle (as '2 hours'), a symbol without bars for so long, by the watermark, has ended: its open
    zone is emitted and its state dropped."""
    quiet = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    if idle:
        bars = bars.withWatermark("ts", late)
    keep = [1 - 2 / (fast + 1), 1 - 2 / (slow + 1)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nf, df_, ns, ds, sign, start, end, n, total = state.get if state.exists else (0.0, 0.0, 0.0, 0.0, 0, None, None, 0, 0.0)
        out = []
        if state.hasTimedOut:
            state.remove()
            if n >= min_duration:
                out.append((key[0], "bull" if total > 0 else "bear", start, end, n))
            yield pd.DataFrame(out, columns=NAMES)
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        if end is not None:
            rows = rows[rows["ts"] > pd.Timestamp(end)]
        for ts, close in zip(rows["ts"], rows["close"]):
            nf, df_ = nf * keep[0] + close, df_ * keep[0] + 1
            ns, ds = ns * keep[1] + close, ds * keep[1] + 1
            value = nf / df_ - ns / ds
            now = 1 if value >= 0 else -1
            if now != sign:
                if n >= min_duration:
                    out.append((key[0], "bull" if total > 0 else "bear", start, end, n))
                sign, start, n, total = now, ts, 0, 0.0
            end, n, total = ts, n + 1, total + value
        state.update((nf, df_, ns, ds, sign, start, end, n, total))
        if quiet and end is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(end).timestamp() * 1000) + quiet, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=NAMES)

    return bars.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, type string, start_ts timestamp, end_ts timestamp, duration long",
        "nf double, df double, ns double, ds double, sign int, start timestamp, end timestamp, n long, total double", "append", GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout,
    )
