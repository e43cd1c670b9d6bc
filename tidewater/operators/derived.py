"""Row-wise and lag-wise derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import OHLC, change, lag, quotient, rolling


def _ohlc() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in OHLC)


def price_averages(df: DataFrame) -> DataFrame:
    o, h, l, c = _ohlc()  # noqa: E741
    return df.withColumns({"hl_avg": (h + l) / 2, "ohlc_avg": (o + h + l + c) / 4, "typical_price": (h + l + c) / 3})


def derived_indicators(df: DataFrame) -> DataFrame:
    """Averages, range, changes, gaps and volume against its mean of 20."""
    o, h, l, c = _ohlc()  # noqa: E741
    df = price_averages(df).withColumns({
        "true_range": h - l, "price_change": c - lag("close"), "price_change_pct": change("close"),
        "gap": o - lag("close"), "gap_pct": F.try_divide(o - lag("close"), lag("close")),
        "volume_sma_20": rolling(F.avg("volume"), "volume", 20),
    })
    return df.withColumn("volume_ratio", F.try_divide(F.col("volume"), F.col("volume_sma_20")))


def full_true_range() -> Column:
    """Largest of the range and the distances to the close before; NULL on a series' first bar."""
    _, h, l, _ = _ohlc()  # noqa: E741
    before = lag("close")
    return F.when(before.isNotNull(), F.greatest(h - l, F.abs(h - before), F.abs(l - before)))


def technical_features(df: DataFrame) -> DataFrame:
    """Candle parts, full true range, position in the bar, rates of change, volume-price trend."""
    o, h, l, c = _ohlc()  # noqa: E741
    return df.withColumns({
        "body_size": c - o, "body_size_pct": F.try_divide(c - o, o), "upper_shadow": h - F.greatest(o, c),
        "lower_shadow": F.least(o, c) - l, "true_range": full_true_range(), "price_change": change("close"),
        "price_change_abs": F.abs(change("close")), "price_position": F.try_divide(c - l, h - l),
        "roc_5": change("close", 5), "roc_10": change("close", 10), "volume_price_trend": F.col("volume") * change("close"),
    })


def lagged(df: DataFrame, columns: list[str], lags: list[int]) -> DataFrame:
    """{column}_lag_{k} for each column and lag."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    if any(k < 0 for k in lags):
        raise ValueError("lags must not be negative")
    return df.withColumns({f"{c}_lag_{k}": lag(c, k) if k else F.col(c) for c in columns for k in lags})


def returns(df: DataFrame, column: str = "close", method: str = "simple", periods: int = 1) -> DataFrame:
    if method == "simple":
        return df.withColumn("returns", change(column, periods))
    if method == "log":
        ratio = F.try_divide(F.col(column), lag(column, periods))
        return df.withColumn("returns", F.when(ratio > 0, F.ln(ratio)))
    raise ValueError(f"unknown method {method}")


def normalise_prices(df: DataFrame, method: str = "first_value", base: str = "close", ieee: bool = False) -> DataFrame:
    """{price}_norm for each price: percent of the base column's first value, percentage change, or z-score. What is divided
    by zero is NULL or, if ieee, infinite or NaN."""
    whole = Window.partitionBy("symbol")
    if method == "first_value":
        first = F.first(base).over(whole.orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumns({f"{c}_norm": quotient(F.col(c), first, ieee) * 100 for c in OHLC})
    if method == "percentage_change":
        return df.withColumns({f"{c}_norm": change(c, ieee=ieee) * 100 for c in OHLC})
    if method == "z_score":
        return df.withColumns({f"{c}_norm": quotient(F.col(c) - F.avg(c).over(whole), F.stddev_samp(c).over(whole), ieee) for c in OHLC})
    raise ValueError(f"unknown method {method}")


def normalise(df: DataFrame, columns: list[str], method: str = "zscore", key: str = "symbol") -> DataFrame:
    """Columns by zscore, minmax or robust (median, unscaled median deviation) within each key; a column without
    spread stays as it is. The figures of a key are one small row that is joined back, so no window holds a key."""
    if method == "zscore":
        parts = [f for c in columns for f in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))]
    elif method == "minmax":
        parts = [f for c in columns for f in (F.min(c).alias(f"__m_{c}"), (F.max(c) - F.min(c)).alias(f"__s_{c}"))]
    elif method == "robust":
        parts = [F.median(c).alias(f"__m_{c}") for c in columns]
    else:
        raise ValueError(f"unknown method {method}")
    df = df.join(df.groupBy(key).agg(*parts), key)
    if method == "robust":
        df = df.join(df.groupBy(key).agg(*[F.median(F.abs(F.col(c) - F.col(f"__m_{c}"))).alias(f"__s_{c}") for c in columns]), key)
    scaled = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.col(c)) for c in columns}
    return df.withColumns(scaled).drop(*[f"__{k}_{c}" for k in "ms" for c in columns])


#: Hours (UTC) of the trading sessions; later rows win where hours overlap.
SESSIONS = (("asian", 0, 8), ("london", 8, 16), ("new_york", 13, 21))
OVERLAP = (13, 16)


def sessions(df: DataFrame, timezone: str = "UTC", ts: str = "ts") -> DataFrame:
    """session and session_overlap by the UTC hour of a local time stamp."""
    hour = F.hour(F.to_utc_timestamp(F.col(ts).cast("timestamp"), timezone))
    label = F.lit("none")
    for name, start, end in SESSIONS:
        label = F.when((hour >= start) & (hour < end), name).otherwise(label)
    return df.withColumns({"session": label, "session_overlap": (hour >= OVERLAP[0]) & (hour < OVERLAP[1])})


def prepared(df: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 5), target: str | None = None) -> DataFrame:
    """Cleaned bars with technical features, lags of all numeric columns but the target, z-scores of prices; rows
    with anything missing go."""
    from tidewater.operators.cleaning import clean

    df = technical_features(clean(df))
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in ("bar_idx", target)]
    df = lagged(df, numeric, [*lags])
    whole = Window.partitionBy("symbol")
    df = df.withColumns({f"{c}_zscore": F.try_divide(F.col(c) - F.avg(c).over(whole), F.stddev_samp(c).over(whole)) for c in OHLC})
    return df.dropna("any")
