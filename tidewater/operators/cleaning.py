"""Filling, outlier removal and repair of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import OHLC, by_bar


def fill(df: DataFrame, columns: list[str], method: str = "forward") -> DataFrame:
    """forward, backward, or linear by position (leading gaps stay, trailing ones repeat the last value)."""
    back = by_bar().rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_bar().rowsBetween(0, Window.unboundedFollowing)
    if method == "forward":
        return df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})
    if method == "backward":
        return df.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in columns})
    if method != "interpolate":
        raise ValueError(f"unknown method {method}")
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("bar_idx").alias("i"), F.col(c).alias("v")))
    df = df.withColumns({f"__b_{c}": F.last(at(c), ignorenulls=True).over(back) for c in columns} | {f"__a_{c}": F.first(at(c), ignorenulls=True).over(ahead) for c in columns})

    def blend(c: str):
        b, a = F.col(f"__b_{c}"), F.col(f"__a_{c}")
        line = b["v"] + (a["v"] - b["v"]) * (F.col("bar_idx") - b["i"]) / (a["i"] - b["i"])
        return F.when(F.col(c).isNotNull(), F.col(c)).when(b.isNull(), F.lit(None)).when(a.isNull(), b["v"]).otherwise(line)

    return df.withColumns({c: blend(c) for c in columns}).drop(*[f"__{k}_{c}" for k in "ab" for c in columns])


def remove_outliers(df: DataFrame, method: str = "zscore", threshold: float = 3.0, columns: tuple[str, ...] = OHLC, key: str = "symbol") -> DataFrame:
    """Column after column, each judged by the figures of the rows that are left: |z| <= threshold, or within
    threshold quartile ranges of the quartiles. Missing values and columns without spread keep no row (zscore)."""
    for c in columns:
        if method == "zscore":
            figures = df.groupBy(key).agg(F.avg(c).alias("__m"), F.stddev_samp(c).alias("__s"))
            df = df.join(figures, key).where(F.abs(F.try_divide(F.col(c) - F.col("__m"), F.col("__s"))) <= threshold).drop("__m", "__s")
        elif method == "iqr":
            figures = df.groupBy(key).agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
            lo, hi = F.col("__q")[0], F.col("__q")[1]
            df = df.join(figures, key).where((F.col(c) >= lo - threshold * (hi - lo)) & (F.col(c) <= hi + threshold * (hi - lo))).drop("__q")
        else:
            raise ValueError(f"unknown method {method}")
    return df


def repair(df: DataFrame) -> DataFrame:
    """Swaps high and low where they are crossed, then clips open and close to them."""
    high, low = F.greatest("high", "low"), F.least("high", "low")
    df = df.withColumns({"high": high, "low": low})
    clip = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, "low"), "high"))
    return df.withColumns({"open": clip("open"), "close": clip("close")})


def clean(df: DataFrame, fill_method: str | None = "forward", outliers: str | None = None, threshold: float = 3.0) -> DataFrame:
    """Rows without any price or volume go; gaps are filled; outliers go if asked for; prices are repaired."""
    values = [c for c in (*OHLC, "volume") if c in df.columns]
    df = df.dropna("all", subset=values)
    if fill_method:
        df = fill(df, values, fill_method)
    if outliers:
        df = remove_outliers(df, outliers, threshold)
    return repair(df)
