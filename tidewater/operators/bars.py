"""Bars from raw events and from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import by_bar


def numbered(df: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """bar_idx: the 0-based position of each row in its series."""
    return df.withColumn("bar_idx", (F.row_number().over(Window.partitionBy(symbol).orderBy(ts)) - 1).cast("long"))


def bars_from_ticks(ticks: DataFrame, symbol: str, ts: str, price: str, unit: str = "hour", volume: str | Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """(symbol, ts, bar_idx, open, high, low, close, volume): first, largest, smallest, last price and summed volume
    of each unit of time; ties of time are broken by the columns tie. Map-side combined, one exchange on
    (symbol, bucket)."""
    order = F.struct(ts, *(tie or []))
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    size = F.col(volume) if isinstance(volume, str) else volume if volume is not None else F.col(price)
    out = ticks.groupBy(F.col(symbol).alias("symbol"), bucket.alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(size).alias("volume")
    )
    return numbered(out)


#: Durations of the named timeframes in seconds, calendar units, and months of the longer ones.
TIMEFRAMES = {**{f"{m}m": 60 * m for m in (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30, 45)}, **{f"{h}h": 3600 * h for h in (1, 2, 3, 4, 6, 8, 12)}}
CALENDAR = {"1d": "day", "1w": "week"}
MONTHS = {"1M": 1, "3M": 3, "6M": 6, "12M": 12}


def is_timeframe(name: str) -> bool:
    """Whether a timeframe can be resampled to; its case counts."""
    return name in TIMEFRAMES or name in CALENDAR or name in MONTHS


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume of each bucket (left-closed,
    left-labelled; weeks begin on Monday); buckets without bars do not exist, those with a missing price go."""
    if timeframe in TIMEFRAMES:
        s = TIMEFRAMES[timeframe]
        epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
        bucket = F.timestamp_seconds(F.floor(epoch / s) * s).cast("timestamp_ntz")
    elif timeframe in CALENDAR:
        bucket = F.date_trunc(CALENDAR[timeframe], F.col("ts")).cast("timestamp_ntz")
    elif timeframe in MONTHS:
        year = F.date_trunc("year", F.col("ts"))
        months = F.floor((F.month("ts") - 1) / MONTHS[timeframe]) * MONTHS[timeframe]
        bucket = F.add_months(year, months.cast("int")).cast("timestamp_ntz")
    else:
        raise ValueError(f"unknown timeframe {timeframe}")
    out = bars.groupBy("symbol", bucket.alias("ts")).agg(
        F.min_by("open", "bar_idx").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_idx").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars")
    )
    return numbered(out.dropna(subset=["open", "high", "low", "close"]))


def crossings(df: DataFrame, a: str, b: str, symbol: str = "symbol", lookback: int = 0) -> DataFrame:
    """signal: 'bullish' where a rises above b, 'bearish' where it falls below, on bars where it happens from the lookback-th on."""
    w = by_bar(symbol)
    pa, pb = F.lag(a).over(w), F.lag(b).over(w)
    up = (F.col(a) > F.col(b)) & (pa <= pb)
    down = (F.col(a) < F.col(b)) & (pa >= pb)
    return df.withColumn("signal", F.when(up, "bullish").when(down, "bearish")).where("signal is not null").where(F.col("bar_idx") >= lookback)


def trend(df: DataFrame, column: str, threshold: float | None = None) -> DataFrame:
    """One row for each symbol: the last two values, whether they rise or fall, and lie beyond the threshold."""
    last = df.where(F.col(column).isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_idx")))).where("k <= 2")
    out = last.groupBy("symbol").agg(F.max(F.when(F.col("k") == 1, F.col(column))).alias("last_value"), F.max(F.when(F.col("k") == 2, F.col(column))).alias("previous_value"))
    level = F.lit(threshold) if threshold is not None else None
    up, down = F.col("last_value") > F.col("previous_value"), F.col("last_value") < F.col("previous_value")
    if level is not None:
        up, down = up & (F.col("last_value") > level), down & (F.col("last_value") < level)
    return out.withColumn("trending_up", F.coalesce(up, F.lit(False))).withColumn("trending_down", F.coalesce(down, F.lit(False)))
