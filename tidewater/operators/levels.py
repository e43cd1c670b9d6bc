"""Support and resistance: local extremes, zones of close prices, breaks, levels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import by_bar

STRONG, CONFIDENT = 0.3, 0.5


def local_extremes(df: DataFrame, window: int = 20) -> DataFrame:
    """(symbol, zone_type, bar_idx, ts, price): lows that are the least, highs that are the most of window bars on
    both sides, where all of these exist."""
    w = by_bar().rowsBetween(-window, window)
    full = F.count(F.lit(1)).over(w) == 2 * window + 1
    df = df.withColumns({"__s": full & (F.col("low") == F.min("low").over(w)), "__r": full & (F.col("high") == F.max("high").over(w))})
    hit = F.filter(F.array(F.when(F.col("__s"), F.struct(F.lit("support").alias("zone_type"), F.col("low").alias("price"))), F.when(F.col("__r"), F.struct(F.lit("resistance").alias("zone_type"), F.col("high").alias("price")))), lambda x: x.isNotNull())
    return df.where("__s or __r").select("symbol", "bar_idx", "ts", F.explode(hit).alias("h")).select("symbol", "h.zone_type", "bar_idx", "ts", "h.price")


def support_resistance(df: DataFrame, window: int = 20, min_touches: int = 2) -> DataFrame:
    """Extremes whose prices, in order, are within a tenth of the standard deviation of closes of the one before
    form a zone; zones have min_touches and at least two. Series shorter than two windows have none."""
    figures = df.groupBy("symbol").agg((F.stddev_samp("close") * 0.1).alias("tolerance"), F.count(F.lit(1)).alias("bars"))
    e = local_extremes(df, window).join(figures.where(F.col("bars") >= 2 * window), "symbol")
    w = Window.partitionBy("symbol", "zone_type").orderBy("price", "bar_idx")
    e = e.withColumn("new", F.coalesce((F.col("price") - F.lag("price").over(w) > F.col("tolerance")).cast("int"), F.lit(1)))
    e = e.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    z = e.groupBy("symbol", "zone_type", "g").agg(F.count(F.lit(1)).alias("touches"), F.min("bar_idx").alias("start_idx"), F.max("bar_idx").alias("end_idx"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.min("price").alias("start_price"), F.max("price").alias("end_price"), F.stddev_pop("price").alias("price_std"))
    z = z.where(F.col("touches") >= max(2, min_touches)).drop("g")
    hours = (F.unix_timestamp(F.col("end_time").cast("timestamp")) - F.unix_timestamp(F.col("start_time").cast("timestamp"))) / 3600
    return z.withColumns({"strength": F.least(F.col("touches") / 5, F.lit(1.0)), "confidence": F.when(hours > 0, F.least(F.col("touches") / hours / 2, F.lit(1.0))).otherwise(1.0), "zone_id": F.concat_ws("_", "zone_type", F.date_format("start_time", "yyyyMMdd_HHmm"), F.date_format("end_time", "yyyyMMdd_HHmm"))})


def breaks(df: DataFrame, zones: DataFrame, block: int = 1024) -> DataFrame:
    """The first bar after each zone that falls below a support or rises above a resistance.

    A zone is held against the extremes of blocks of bars, which give the first later block that breaks it; then only
    the bars of that block and of the block where the zone ends are looked at, by (symbol, block)."""
    own = ["symbol", "zone_id", "zone_type", "strength", "confidence"]
    z = zones.select(*own, "end_idx", "start_price", "end_price").withColumn("__b", F.floor(F.col("end_idx") / block))
    support = F.col("zone_type") == "support"
    b = df.select("symbol", "bar_idx", "high", "low", "close").withColumn("block", F.floor(F.col("bar_idx") / block))
    extremes = b.groupBy("symbol", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    broken = F.when(support, F.col("low") < F.col("start_price")).otherwise(F.col("high") > F.col("end_price"))
    later = extremes.join(z, "symbol").where((F.col("block") > F.col("__b")) & broken)
    later = later.groupBy(*own, "end_idx", "start_price", "end_price").agg(F.min("block").alias("block"))
    looked = later.unionByName(z.withColumnRenamed("__b", "block"))
    hit = b.join(looked, ["symbol", "block"]).where((F.col("bar_idx") > F.col("end_idx")) & broken)
    return hit.groupBy(*own).agg(F.min("bar_idx").alias("break_idx"), F.min_by("close", "bar_idx").alias("break_price"))


def level_summary(zones: DataFrame) -> DataFrame:
    return zones.groupBy("symbol", "zone_type").agg(F.count(F.lit(1)).alias("zones"), F.avg("strength").alias("mean_strength"), F.max("strength").alias("max_strength"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("strength") >= STRONG).alias("strong"), F.count_if(F.col("confidence") >= CONFIDENT).alias("confident"))


def price_levels(prices: DataFrame, column: str, tolerance: float = 0.01, key: str = "symbol") -> DataFrame:
    """Levels of each key: sorted prices join the level before while they are within tolerance of its running mean.
    The fold depends on all prices before, so it is an aggregate over a key's sorted zone prices (few by nature)."""
    state = "struct<level: double, n: bigint, out: array<struct<level: double, n: bigint>>>"
    folded = F.aggregate(
        F.sort_array(F.collect_list(F.col(column).cast("double"))),
        F.lit(None).cast(state),
        lambda s, p: F.when(s.isNull(), F.struct(p.alias("level"), F.lit(1).cast("bigint").alias("n"), F.array().cast("array<struct<level: double, n: bigint>>").alias("out")))
        .when(F.abs(p - s["level"]) <= s["level"] * tolerance, F.struct(((s["level"] * s["n"] + p) / (s["n"] + 1)).alias("level"), (s["n"] + 1).alias("n"), s["out"].alias("out")))
        .otherwise(F.struct(p.alias("level"), F.lit(1).cast("bigint").alias("n"), F.concat(s["out"], F.array(F.struct(s["level"].alias("level"), s["n"].alias("n")))).alias("out"))),
        lambda s: F.concat(s["out"], F.array(F.struct(s["level"].alias("level"), s["n"].alias("n")))),
    )
    return prices.where(F.col(column).isNotNull()).groupBy(key).agg(folded.alias("levels")).select(key, F.explode("levels").alias("l")).select(key, "l.level", "l.n")


def near_levels(df: DataFrame, levels: DataFrame, column: str, tolerance: float = 0.01, near: bool = True) -> DataFrame:
    """Rows whose value is (not) within tolerance (a share of the level, below a half) of some level of its symbol: a semi or
    anti join. Prices are cut into bins of the width of the tolerance in their logarithm, and a level is near those of
    its own and the neighbouring bins."""
    if not 0 < tolerance < 0.5:
        raise ValueError("tolerance must be above 0 and below 0.5")
    width = -math.log1p(-tolerance)
    bin_of = lambda c: F.when(c > 0, F.floor(F.ln(c) / width)).when(c == 0, F.lit(-(1 << 40)))
    lv = levels.select(F.col("symbol").alias("__s"), F.col("level").cast("double").alias("__level")).where("__level >= 0")
    lv = lv.withColumn("__b", F.explode(F.sequence(bin_of(F.col("__level")) - 1, bin_of(F.col("__level")) + 1)))
    rows = df.withColumn("__bin", bin_of(F.col(column).cast("double")))
    on = (rows["symbol"] == F.col("__s")) & (F.col("__bin") == F.col("__b")) & (F.abs(rows[column] - F.col("__level")) <= F.col("__level") * tolerance)
    return rows.join(lv, on, "left_semi" if near else "left_anti").drop("__bin")
