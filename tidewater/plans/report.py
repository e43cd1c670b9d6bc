"""The MACD report: one row a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits that the words of a report depend on.
MOSTLY, LONG_ZONES, STRONG_HISTOGRAM = 0.6, 20, 2


def macd_report(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """Periods, prices, zones and the last MACD of each series, and what they say: recommendation, bias of the zones, their
    length, momentum. bars need macd and macd_signal, zones type, duration and start_idx."""
    b = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("periods"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("close", "bar_idx").alias("close"),
        F.max_by("macd", "bar_idx").alias("macd"), F.max_by("macd_signal", "bar_idx").alias("macd_signal"),
    )
    z = zones.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("zones"), F.count_if(F.col("type") == "bull").alias("bull_zones"), F.count_if(F.col("type") == "bear").alias("bear_zones"),
        F.avg("duration").alias("mean_duration"), F.max_by("type", "start_idx").alias("last_type"),
    )
    r = b.join(z, "symbol", "left").fillna(0, ["zones", "bull_zones", "bear_zones"])
    h, share = F.col("macd") - F.col("macd_signal"), F.try_divide(F.col("bull_zones"), F.col("zones"))
    r = r.withColumn("histogram", h)
    advice = F.when((F.col("last_type") == "bull") & (h > 0), "bullish").when((F.col("last_type") == "bear") & (h < 0), "bearish").otherwise("neutral")
    return r.withColumns({
        "recommendation": advice, "bias": F.when(share > MOSTLY, "bull").when(share < 1 - MOSTLY, "bear").when(share.isNotNull(), "balanced"),
        "zone_length": F.when(F.col("mean_duration") > LONG_ZONES, "long").when(F.col("mean_duration") > 0, "short"),
        "momentum": F.when(F.abs(h) > STRONG_HISTOGRAM, "strong").when(h.isNotNull(), "weak"),
    }).drop("last_type")
